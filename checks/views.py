"""Inputs of panel shape derived from the test tables.

Each view exists twice: as a DataFrame for the library, and as SQL for the
comparison, under the same name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.names import commune_code, election_year
from panelweave.functions.predicates import not_in
from panelweave.operators.distribution import impute_medians
from panelweave.operators.labels import last_wins
from panelweave.storage import stage

FEATURES = ["f_qty", "f_price", "f_discount", "f_tax", "f_size", "f_retail", "f_lines"]
VOTES = ["pvotea", "pvoteb"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _code(column: str):
    return F.lpad(F.col(column).cast("string"), 5, "0")


def _election_id():
    kind = (
        F.when(F.col("o_orderstatus") == "F", "pres")
        .when(F.col("o_orderstatus") == "O", "legi")
        .otherwise("euro")
    )
    return F.concat(F.year("o_orderdate").cast("string"), F.lit("_"), kind, F.lit("_t1"))


def vote_detail(spark, sf) -> DataFrame:
    code = _code("o_custkey")
    return table(spark, sf, "orders").select(
        _election_id().alias("id_election"),
        F.substring(code, 1, 2).alias("dept"),
        F.substring(code, 3, 3).alias("commune"),
        F.when(F.col("o_orderkey") % 10 != 0, F.substring("o_orderpriority", 1, 1)).alias("nuance"),
        F.when(F.col("o_orderkey") % 13 == 0, F.lit(0))
        .otherwise(F.floor("o_totalprice")).cast("long").alias("voix"),
    )


def registered_detail(spark, sf) -> DataFrame:
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        _election_id().alias("id_election"),
        _code("o_custkey").alias("codecommune"),
        F.when(F.col("o_custkey") % 17 == 0, F.lit(0))
        .otherwise(F.col("l_quantity")).cast("long").alias("inscrits"),
    )


def _european(df: DataFrame) -> DataFrame:
    return df.filter(not_in(F.substring("id_election", 6, 4), ["pres", "legi"], keep_null=False))


def ballots(spark, sf) -> DataFrame:
    return _european(vote_detail(spark, sf)).select(
        election_year(F.col("id_election")).alias("annee"),
        commune_code(F.col("dept"), F.col("commune")).alias("codecommune"),
        "dept", "commune", "nuance", "voix",
    )


def registered(spark, sf) -> DataFrame:
    return _european(registered_detail(spark, sf)).select(
        election_year(F.col("id_election")).alias("annee"), "codecommune", "inscrits"
    )


_NUANCE_ROWS = [(1, "1", "Droite"), (2, "2", None), (3, "3", "Centre"), (4, "5", "Droite"), (5, "1", "Gauche")]
_LIBELLE_ROWS = [(1, "2", "Droite"), (2, "4", "Centre-droit"), (3, "2", "Centre-gauche"), (4, "3", "Gauche")]


def label_maps(spark) -> list[DataFrame]:
    def literal(rows):
        return ", ".join(f"({p}, '{n}', {repr(t) if t else 'cast(null as string)'})" for p, n, t in rows)

    return [
        last_wins(
            spark.sql(f"select * from values {literal(rows)} as t(position, nuance, tendance)"),
            "nuance", "tendance", "position",
        )
        for rows in (_NUANCE_ROWS, _LIBELLE_ROWS)
    ]


def votes_long(spark, sf) -> DataFrame:
    kind = (
        F.when(F.col("o_orderstatus") == "F", "presidentiel")
        .when(F.col("o_orderstatus") == "O", "legislative")
        .otherwise("referendum")
    )
    n = F.count(F.lit(1)).cast("double")
    priority = F.col("o_orderpriority")
    return (
        table(spark, sf, "orders")
        .groupBy(
            _code("o_custkey").alias("codecommune"),
            kind.alias("election_type"),
            F.year("o_orderdate").alias("annee"),
        )
        .agg(
            n.alias("inscrits"),
            (F.count_if(priority.isin("1-URGENT", "2-HIGH")) / n).alias("pvotea"),
            (F.count_if(priority == "5-LOW") / n).alias("pvoteb"),
        )
    )


def votes_gappy(spark, sf) -> DataFrame:
    """votes_long with zero shares taken as missing."""
    return votes_long(spark, sf).withColumns({v: F.nullif(F.col(v), F.lit(0.0)) for v in VOTES})


def feature_long(spark, sf) -> DataFrame:
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    year = F.year("l_shipdate")
    cells = (
        lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy(_code("o_custkey").alias("codecommune"), year.alias("annee"))
        .agg(
            F.sum("l_quantity").alias("qty"),
            F.count(F.lit(1)).cast("double").alias("n"),
            F.max("l_extendedprice").alias("price"),
        )
    )
    y = F.col("annee")
    kinds = {
        "qty": F.col("qty"),
        "lines": F.when(y % 2 == 1, F.col("n")),
        "maxprice": F.when(y.isin(1996, 2000), F.col("price")),
        "base": F.when(y == 1995, F.col("n")),
    }
    entries = F.array(
        *[F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in kinds.items()]
    )
    return cells.select("codecommune", "annee", F.inline(entries)).filter("value is not null").select(
        "codecommune", "feature", "annee", "value"
    )


def geo_shape(spark, sf) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf, "customer").filter(key % 7 != 0).select(
        key.alias("key"),
        _code("c_custkey").alias("codecommune"),
        (key % 100).cast("double").alias("x0"),
        F.floor(key / 100).cast("double").alias("y0"),
        (1 + nation % 3).cast("double").alias("w"),
        (1 + nation % 2).cast("double").alias("h"),
    )


def rectangle(x0: str = "x0", y0: str = "y0", w: str = "w", h: str = "h"):
    """Closed ring of an axis-aligned rectangle."""
    x, y, right, top = F.col(x0), F.col(y0), F.col(x0) + F.col(w), F.col(y0) + F.col(h)
    corners = [(x, y), (right, y), (right, top), (x, top), (x, y)]
    return F.array(*[F.array(a, b) for a, b in corners])


def customers(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(
        _code("c_custkey").alias("codecommune"), F.col("c_acctbal").alias("balance")
    )


def gappy_customers(spark, sf) -> DataFrame:
    """Columns missing in a half, two thirds and a tenth of the rows."""
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        _code("c_custkey").alias("codecommune"),
        (F.col("c_nationkey") % 2).cast("int").alias("type"),
        balance.alias("full"),
        F.when(key % 2 == 1, balance).alias("half"),
        F.when(key % 3 == 0, balance).alias("third"),
        F.when(key % 10 != 0, balance).alias("tenth"),
    )


def ml_matrix(spark, sf) -> DataFrame:
    lines, orders, parts = (table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    joined = lines.join(parts, F.col("p_partkey") == F.col("l_partkey"))
    per_order = joined.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("f_qty"),
        F.max("l_extendedprice").alias("f_price"),
        F.max("l_discount").alias("f_discount"),
        F.max("l_tax").alias("f_tax"),
        F.sum("p_size").cast("double").alias("f_size"),
        F.max("p_retailprice").alias("f_retail"),
        F.count(F.lit(1)).cast("double").alias("f_lines"),
    )
    key = F.col("o_orderkey")
    return per_order.join(orders, F.col("l_orderkey") == key).select(
        key.alias("row_id"),
        "f_qty", "f_price",
        F.when(key % 11 != 0, F.col("f_discount")).alias("f_discount"),
        "f_tax", "f_size", "f_retail", "f_lines",
        F.col("o_totalprice").alias("y"),
    )


def stored(view, spark, sf) -> DataFrame:
    """A view written once, for operators that read their input several times."""
    return stage(view(spark, sf), view.__name__)


def ml_filled(spark, sf) -> DataFrame:
    return impute_medians(stored(ml_matrix, spark, sf), FEATURES)


# --------------------------------------------------------------------------
# SQL twins

_VALUES = "position, nuance, tendance"

VIEWS: dict[str, str] = {
    "vote_detail": """
        select concat(cast(year(o_orderdate) as varchar), '_',
                 case o_orderstatus when 'F' then 'pres' when 'O' then 'legi' else 'euro' end, '_t1') as id_election,
               substring(lpad(cast(o_custkey as varchar), 5, '0'), 1, 2) as dept,
               substring(lpad(cast(o_custkey as varchar), 5, '0'), 3, 3) as commune,
               case when o_orderkey % 10 = 0 then null else substring(o_orderpriority, 1, 1) end as nuance,
               case when o_orderkey % 13 = 0 then 0 else cast(floor(o_totalprice) as bigint) end as voix
        from orders""",
    "registered_detail": """
        select concat(cast(year(o.o_orderdate) as varchar), '_',
                 case o.o_orderstatus when 'F' then 'pres' when 'O' then 'legi' else 'euro' end, '_t1') as id_election,
               lpad(cast(o.o_custkey as varchar), 5, '0') as codecommune,
               case when o.o_custkey % 17 = 0 then 0 else cast(l.l_quantity as bigint) end as inscrits
        from orders o join lineitem l on l.l_orderkey = o.o_orderkey""",
    "ballots": """
        select cast(substring(id_election, 1, 4) as int) as annee, dept || commune as codecommune,
               dept, commune, nuance, voix
        from vote_detail where id_election like '%euro%'""",
    "registered": """
        select cast(substring(id_election, 1, 4) as int) as annee, codecommune, inscrits
        from registered_detail where id_election like '%euro%'""",
    "nuance_map": f"""
        select * from (values (1, '1', 'Droite'), (2, '2', null), (3, '3', 'Centre'), (4, '5', 'Droite'),
          (5, '1', 'Gauche')) as t({_VALUES})""",
    "libelle_map": f"""
        select * from (values (1, '2', 'Droite'), (2, '4', 'Centre-droit'), (3, '2', 'Centre-gauche'),
          (4, '3', 'Gauche')) as t({_VALUES})""",
    "nuance_last": """
        select nuance, tendance from nuance_map
        qualify row_number() over (partition by nuance order by position desc) = 1""",
    "libelle_last": """
        select nuance, tendance from libelle_map
        qualify row_number() over (partition by nuance order by position desc) = 1""",
    "labelled": """
        select b.*, coalesce(n.tendance, l.tendance) as tendance from ballots b
        left join nuance_last n on n.nuance = b.nuance left join libelle_last l on l.nuance = b.nuance""",
    "bloc_sums": """
        select annee, codecommune, tendance, sum(voix) as voix from labelled
        where tendance is not null group by all""",
    "bloc_wide": """
        select annee, codecommune,
          coalesce(sum(voix) filter (tendance = 'Centre'), 0) as pvotepvoteC,
          coalesce(sum(voix) filter (tendance = 'Centre-droit'), 0) as pvotepvoteCD,
          coalesce(sum(voix) filter (tendance = 'Centre-gauche'), 0) as pvotepvoteCG,
          coalesce(sum(voix) filter (tendance = 'Droite'), 0) as pvotepvoteD,
          coalesce(sum(voix) filter (tendance = 'Gauche'), 0) as pvotepvoteG
        from bloc_sums group by annee, codecommune""",
    "bloc_total": """
        select *, pvotepvoteC + pvotepvoteCD + pvotepvoteCG + pvotepvoteD + pvotepvoteG as exprimes
        from bloc_wide""",
    "bloc_share": """
        select annee, codecommune, exprimes,
          case when exprimes <> 0 then cast(pvotepvoteC as double) / exprimes else 0 end as pvotepvoteC,
          case when exprimes <> 0 then cast(pvotepvoteCD as double) / exprimes else 0 end as pvotepvoteCD,
          case when exprimes <> 0 then cast(pvotepvoteCG as double) / exprimes else 0 end as pvotepvoteCG,
          case when exprimes <> 0 then cast(pvotepvoteD as double) / exprimes else 0 end as pvotepvoteD,
          case when exprimes <> 0 then cast(pvotepvoteG as double) / exprimes else 0 end as pvotepvoteG
        from bloc_total""",
    "registered_sum": """
        select annee, codecommune, cast(sum(inscrits) as bigint) as inscrits from registered group by all""",
    "votes_long": """
        select lpad(cast(o_custkey as varchar), 5, '0') as codecommune,
          case o_orderstatus when 'F' then 'presidentiel' when 'O' then 'legislative' else 'referendum' end
            as election_type,
          cast(year(o_orderdate) as int) as annee,
          cast(count(*) as double) as inscrits,
          cast(sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end) as double)
            / count(*) as pvotea,
          cast(sum(case when o_orderpriority = '5-LOW' then 1 else 0 end) as double) / count(*) as pvoteb
        from orders group by 1, 2, 3""",
    "votes_gappy": """
        select codecommune, election_type, annee, inscrits, nullif(pvotea, 0) as pvotea,
          nullif(pvoteb, 0) as pvoteb from votes_long""",
    "election_years": """
        select election_type, annee, lag(annee, 1) over w as y1, lag(annee, 2) over w as y2
        from (select distinct election_type, annee from votes_long)
        window w as (partition by election_type order by annee)""",
    "votes_history": """
        select v.*, a.pvotea as pvotepreviousa, a.pvoteb as pvotepreviousb,
          b.pvotea as pvotepreviouspreviousa, b.pvoteb as pvotepreviouspreviousb
        from votes_gappy v join election_years e using (election_type, annee)
        left join votes_gappy a on a.codecommune = v.codecommune and a.election_type = v.election_type
          and a.annee = e.y1
        left join votes_gappy b on b.codecommune = v.codecommune and b.election_type = v.election_type
          and b.annee = e.y2""",
    "feature_long": """
        select codecommune, feature, annee, value from (
          select lpad(cast(o.o_custkey as varchar), 5, '0') as codecommune,
            cast(year(l.l_shipdate) as int) as annee, 'qty' as feature,
            cast(sum(l.l_quantity) as double) as value
          from orders o join lineitem l on l.l_orderkey = o.o_orderkey group by 1, 2
          union all
          select lpad(cast(o.o_custkey as varchar), 5, '0'), cast(year(l.l_shipdate) as int), 'lines',
            cast(count(*) as double)
          from orders o join lineitem l on l.l_orderkey = o.o_orderkey
          where year(l.l_shipdate) % 2 = 1 group by 1, 2
          union all
          select lpad(cast(o.o_custkey as varchar), 5, '0'), cast(year(l.l_shipdate) as int), 'maxprice',
            max(l.l_extendedprice)
          from orders o join lineitem l on l.l_orderkey = o.o_orderkey
          where year(l.l_shipdate) in (1996, 2000) group by 1, 2
          union all
          select lpad(cast(o.o_custkey as varchar), 5, '0'), cast(year(l.l_shipdate) as int), 'base',
            cast(count(*) as double)
          from orders o join lineitem l on l.l_orderkey = o.o_orderkey
          where year(l.l_shipdate) = 1995 group by 1, 2) t""",
    "catalog": """
        select feature, annee, lag(annee) over (partition by feature order by annee) as prev_annee,
          lead(annee) over (partition by feature order by annee) as next_annee
        from (select distinct feature, annee from feature_long)""",
    "grid": """
        select e.codecommune, c.feature, c.annee, f.value
        from (select distinct codecommune from feature_long) e cross join catalog c
        left join feature_long f on f.codecommune = e.codecommune and f.feature = c.feature
          and f.annee = c.annee""",
    "bounds": """
        select feature, annee, quantile_cont(value, 0.01) as low, quantile_cont(value, 0.99) as high
        from feature_long group by feature, annee""",
    "winsored": """
        select g.codecommune, g.feature, g.annee, g.value,
          case when g.value is not null then greatest(b.low, least(b.high, g.value)) end as winsor,
          case when g.value is not null then
            (rank() over (partition by g.feature, g.annee order by g.value asc nulls last)
             + (count(*) over (partition by g.feature, g.annee, g.value) - 1) / 2.0)
            / count(g.value) over (partition by g.feature, g.annee) end as rank
        from grid g join bounds b on b.feature = g.feature and b.annee = g.annee""",
    "lagged": """
        select *, lag(value) over w as prev_value, lag(winsor) over w as prev_winsor from winsored
        window w as (partition by codecommune, feature order by annee)""",
    "resolved": """
        select c.feature, t.annee as target, max(c.annee) as annee
        from catalog c join (select distinct annee from votes_long) t
          on c.annee between t.annee - 5 and t.annee
        group by 1, 2""",
    "geo_shape": """
        select c_custkey as key, lpad(cast(c_custkey as varchar), 5, '0') as codecommune,
          cast(c_custkey % 100 as double) as x0, cast(floor(c_custkey / 100) as double) as y0,
          cast(1 + c_nationkey % 3 as double) as w, cast(1 + c_nationkey % 2 as double) as h
        from customer where c_custkey % 7 <> 0""",
    "gappy_customers": """
        select lpad(cast(c_custkey as varchar), 5, '0') as codecommune, cast(c_nationkey % 2 as int) as type,
          c_acctbal as "full", case when c_custkey % 2 = 1 then c_acctbal end as half,
          case when c_custkey % 3 = 0 then c_acctbal end as third,
          case when c_custkey % 10 <> 0 then c_acctbal end as tenth
        from customer""",
    "ml_matrix": """
        select o.o_orderkey as row_id, sum(l.l_quantity) as f_qty, max(l.l_extendedprice) as f_price,
          case when o.o_orderkey % 11 = 0 then null else max(l.l_discount) end as f_discount,
          max(l.l_tax) as f_tax, cast(sum(p.p_size) as double) as f_size, max(p.p_retailprice) as f_retail,
          cast(count(*) as double) as f_lines, max(o.o_totalprice) as y
        from lineitem l join part p on p.p_partkey = l.l_partkey join orders o on o.o_orderkey = l.l_orderkey
        group by o.o_orderkey""",
    "ml_filled": """
        select * replace (coalesce(f_discount, (select quantile_cont(f_discount, 0.5) from ml_matrix))
          as f_discount) from ml_matrix""",
    "ml_ordered": """
        select *, md5(concat(row_id, '|42')) as token,
          row_number() over (order by md5(concat(row_id, '|42'))) as place, count(*) over () as n
        from ml_filled""",
    "ml_test": "select * from ml_ordered where place <= ceil(round(0.15 * n, 6))",
}


def with_views(sql: str) -> str:
    """Prefix a query with the views it uses, and those that they use."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(sql)
    parts = [f"{name} as ({VIEWS[name]}\n)" for name in VIEWS if name in needed]
    return f"with {', '.join(parts)}\n{sql}" if parts else sql
