"""The queries of the operators, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import (
    chat,
    clustering,
    decontaminate,
    langid,
    lexical,
    linededup,
    mixing,
    neardup,
    passages,
    quality,
    records,
    simhash,
    topk,
)
from panelweave.llm.common import table
from panelweave.storage import new_path, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql.strip()
        return function

    return register


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op1_token_records(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    index = records.write_token_records(docs, new_path(spark, "records"), tokenizer_path())
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")


def _crc(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary"))


@query()
def op3_quality_fm(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf, "labels").where(_crc("doc_id") % 4 != 2)
    machine = quality.fit_quality(docs, labels)
    scored = quality.score_quality(docs, machine, keep=["doc_id"])
    held_out = F.coalesce(_crc("doc_id") % 4 == 2, F.lit(True))  # a row without id is not learned from
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op4_byte_cnn_language(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_crc("doc_id") % 5 == 0, F.lit(True))
    languages, weights = langid.fit_languages(docs.where(~held_out))
    guessed = langid.predict(docs, languages, weights, keep=["doc_id"])
    return guessed.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


_OP2_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query(rf"""
with d as (select doc_id, coalesce({_OP2_WORDS}, []) as w from documents),
  i as (select item_id, coalesce({_OP2_WORDS}, []) as w from benchmark),
  iw as (select distinct item_id, array_to_string(w[s + 1 : least(s + 10, len(w))], ' ') as win, least(10, len(w)) as n
    from (select item_id, w, unnest(range(greatest(1, len(w) - 9))) as s from i where len(w) > 0)),
  lens as (select distinct n from iw),
  dw as (select doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') as win
    from (select doc_id, w, n, unnest(range(len(w) - n + 1)) as s from d, lens where len(w) >= n)),
  hits as (select doc_id, s, n, item_id from dw join iw using (n, win)),
  places as (select doc_id, count(*) as n_hit from (
    select distinct doc_id, unnest(range(s, s + n)) as p from hits) group by doc_id),
  owners as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (
    select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (doc_id) left join owners using (doc_id)
""")
def op2_decontaminate(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("""
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
    from embeddings where embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  s as (select q.vec_id as query_id, c.vec_id,
      cast(list_inner_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) as score
    from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
  r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
""")
def op5_exact_topk(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)


@query("""
with m as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(8 + 8 + 7 + length(role) + length(text)
    + length(regexp_replace(role || text, '[^<\\[]', '', 'g'))) as bigint) as formatted_chars
from m group by conv_id
""")
def op6_chat_format(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = "'</s>[INST] ok [/INST]'"
    more = spark.sql(f"select -7L as conv_id, 0L as turn, 'user' as role, {said} as text union all select -7L, 1L, 'assistant', {said}")
    rows = rows.unionByName(more).withColumn("parts", chat.text_part(F.col("text")))
    out = stage(chat.format_chat(rows), "chats")
    turns = chat.read_turns(F.col("formatted"))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    read = out.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query(r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents),
  s as (select source, sum(size) as source_size, row_number() over (order by source nulls last) - 1 as nr from d group by source),
  w as (select *, [5.0, 2.0, 1.0][nr % 3 + 1]::double as weight, 3 * source_size as cap from s),
  l as (select *, row_number() over r as nth,
      (sum(source_size) over () - coalesce(sum(cap) over (r rows between unbounded preceding and 1 preceding), 0))::double
      / (sum(weight) over () - coalesce(sum(weight) over (r rows between unbounded preceding and 1 preceding), 0)) as level
    from w window r as (order by source_size / weight, source nulls last)),
  f as (select min(nth) as first from l where level * weight <= cap),
  t as (select source, source_size, case when nth >= first then (select level from l where nth = first) * weight
      else cap::double end as target, cap from l, f),
  p as (select d.*, t.source_size, t.target, least(cast(round(t.target) as bigint), cap) as goal,
      coalesce(sum(d.size) over (partition by d.source order by md5('0|' || d.doc_id), d.doc_id
        rows between unbounded preceding and 1 preceding), 0) as start
    from d join t on d.source is not distinct from t.source)
select doc_id, size, cast(source_size as bigint) as source_size, target, cast(case when size = 0 then 0 else
  list_sum([greatest(0, least(start + e * source_size + size, goal) - (start + e * source_size)) for e in range(3)]) end as bigint) as taken
from p
""")
def op7_source_mix(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return mixing.taken_words(docs).select("doc_id", "size", "source_size", "target", "taken")


@query(r"""
with recursive d as (select doc_id, coalesce(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
  s as (select distinct doc_id, array_to_string(w[i : i + 3], ' ') as sh
    from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) as i from d where len(w) > 0)),
  n as (select doc_id, count(*) as n from s group by doc_id),
  links as (select a.doc_id as a, b.doc_id as b from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id
      join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
    group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
  reach(doc_id, other) as (select doc_id, doc_id from d union select r.doc_id, l.b from reach r join links l on l.a = r.other)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from d left join n using (doc_id) join (select doc_id, min(other) as component_id from reach group by doc_id) c using (doc_id)
""")
def op10_minhash_neardup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = neardup.near_duplicates(docs)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@query(r"""
with d as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
  a as (select doc_id, n, s, len(lines) as size, array_to_string(lines[s + 1 : s + n], chr(10)) as win
    from (select doc_id, lines, n, unnest(range(len(lines) - n + 1)) as s
      from d, (select unnest([1, 2, 3]) as n) where len(lines) >= n)),
  c as (select *, len(regexp_extract_all(win, '[^\x20\x09-\x0D]+')) as words from a),
  w as (select doc_id, n, s, win, false as whole from c where n = 3 or words >= 50
    union all select doc_id, n, s, win, true from c where n < 3 and n = size and words > 0),
  r as (select doc_id, s, n from (
    select *, row_number() over (partition by win, n, whole order by doc_id, s) as nth from w) where nth > 1),
  g as (select distinct doc_id, unnest(range(s, s + n)) as p from r),
  l as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as p from d),
  k as (select l.doc_id, count(*) as n_lines, count(g.p) as n_removed,
      string_agg(line, chr(10) order by l.p) filter (g.p is null) as kept
    from l left join g on g.doc_id = l.doc_id and g.p = l.p group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed,
  case when d.text is null then null else sha256(coalesce(kept, '')) end as kept_sha256
from d left join k using (doc_id)
""")
def op8_line_winnowing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cleaned = linededup.without_repeated_runs(docs)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op9_compact_windows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return passages.passage_classes(docs)


@query(rf"""
with d as (select doc_id, coalesce({_OP2_WORDS}, []) as w from documents where doc_id is not null),
  n as (select doc_id, len(w) as n from d where len(w) > 0),
  t as (select count(*) as docs, cast(sum(n) as bigint) as words from n),
  i as (select distinct item_id, unnest(coalesce({_OP2_WORDS}, [])) as term from benchmark where item_id is not null),
  p as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from d)
    where term in (select term from i) group by doc_id, term),
  w as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as w
    from (select term, count(*) as df from p group by term), t),
  s as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)))) as bigint) as score
    from i join p using (term) join w using (term) join n using (doc_id), t group by item_id, doc_id),
  r as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 50
""")
def op11_stratified_search(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lexical.search(docs, table(spark, sf, "benchmark").select("item_id", "text"))


def _kmeans_sql(rounds: int, k: int) -> str:
    parts = [f"""v as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
      from embeddings where vec_id is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    c0 as materialized (select cast(row_number() over (order by sha256('2:' || vec_id), e) - 1 as integer) as c, e from v qualify c < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} as materialized (select vec_id, any_value(v.e) as e, min({{'d': cast(list_inner_product(cast(v.e as double[]), cast(v.e as double[]))
        - 2 * list_inner_product(cast(v.e as double[]), cast(c{r}.e as double[]))
        + list_inner_product(cast(c{r}.e as double[]), cast(c{r}.e as double[])) as bigint), 'c': c}}) as best
      from v, c{r} group by vec_id)""")
        if r < rounds:
            parts.append(f"""m{r} as (select c, list((s - ((s % n) + n) % n) // n order by i) as e from (
        select best.c as c, i, sum(e[i]) as s, count(*) as n from a{r}, range(1, 65) g(i) group by best.c, i) group by c),
      c{r + 1} as materialized (select c{r}.c, cast(coalesce(m{r}.e, c{r}.e) as bigint[]) as e from c{r} left join m{r} on c{r}.c = m{r}.c)""")
    return f"""with {", ".join(parts)}
      select vec_id, best.c as cluster, best.d as distance, cast(sum(best.d) over (partition by best.c) as bigint) as cluster_inertia,
        cast(sum(best.d) over () as bigint) as inertia, sha256(array_to_string(c{rounds}.e, ',')) as centroid_sha256
      from a{rounds} join c{rounds} on best.c = c"""


@query(_kmeans_sql(clustering.ROUNDS, clustering.K))
def op12_orchard_clusters(spark, sf):
    return clustering.cluster(table(spark, sf, "embeddings").select("vec_id", "embedding"))


@query()
def op13_pigeonhole_simhash(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.as_hex(F.col("print")).alias("fingerprint"), "component_id")
