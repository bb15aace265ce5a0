"""The queries against their SQL, and the pipeline against its stages done by hand."""

import pytest
from pyspark.sql import functions as F

from checks import registry
from checks.compare import compare, duck
from panelweave.llm import linededup, queries
from tests.llm.helpers import blank_words, plain_words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_sql(spark, con, name, monkeypatch):
    monkeypatch.setitem(registry.QUERIES, name, queries.QUERIES[name])
    monkeypatch.setitem(registry.ORACLES, name, queries.ORACLES[name])
    assert compare(spark, con, SF, name) is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_token_records_query(spark):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(queries.tokenizer_path()), 0
    found = {r["doc_id"]: r for r in queries.QUERIES["op1_token_records"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        got = found.pop(r["doc_id"])
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not found


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [plain_words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}
    tables = [docs]
    for _, function in corpus_pipeline.STAGES:
        tables.append(function(spark, tables[-1], SF).cache())
    assert all(t.columns == docs.columns for t in tables[:-1])
    texts = [sorted((r["doc_id"], r["text"]) for r in t.collect()) for t in tables[:-1]]
    assert texts[1] == texts[0]  # all of these documents have letters in a known language
    sets = [(d, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))) for d, t in texts[1] for w in [blank_words(t)] if w]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if 10 * min(len(x), len(y)) >= 8 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    assert texts[2] == [r for r in texts[1] if parent.get(r[0], r[0]) == r[0]]

    def hit(text):
        w = plain_words(text)
        return any(tuple(w[i : i + 10]) in windows for i in range(len(w)))

    assert texts[3] == [r for r in texts[2] if not hit(r[1])]
    assert {r for r in texts[4]} <= {r for r in texts[3]} and len(texts[4]) > 0
    last = tables[-1].collect()
    assert sorted(r["doc_id"] for r in last) == [d for d, _ in texts[4]]
    assert corpus_pipeline.run(spark, SF).count() == len(last)


RUNS_OF_WINDOWS = """
with d as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
  w as (select doc_id, s, array_to_string(lines[s + 1 : s + {n}], chr(10)) as win
    from (select doc_id, lines, unnest(range(len(lines) - {n} + 1)) as s from d where len(lines) >= {n})),
  r as (select doc_id, s from (select *, row_number() over (partition by win order by doc_id, s) as nth from w) where nth > 1),
  g as (select distinct doc_id, unnest(range(s, s + {n})) as p from r),
  l as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as p from d),
  k as (select l.doc_id, count(*) as n_lines, count(g.p) as n_removed,
      string_agg(line, chr(10) order by l.p) filter (g.p is null) as kept
    from l left join g on g.doc_id = l.doc_id and g.p = l.p group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed,
  case when d.text is null then null else sha256(coalesce(kept, '')) end as kept_sha256
from d left join k using (doc_id)
"""


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_line_runs_of_any_window_match_sql(spark, con, monkeypatch, window):
    def line_runs(spark, sf):
        docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
        cleaned = linededup.without_repeated_runs(docs, window=window, min_words=None)
        return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))

    monkeypatch.setitem(registry.QUERIES, "line_runs", line_runs)
    monkeypatch.setitem(registry.ORACLES, "line_runs", RUNS_OF_WINDOWS.format(n=window).strip())
    assert compare(spark, con, SF, "line_runs") is None
