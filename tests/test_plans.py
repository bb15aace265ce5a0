"""Physical plans: what is pushed down, broadcast and exchanged."""

import re

import pytest
from pyspark.sql import functions as F

from checks import registry, views
from panelweave.functions.geometry import polygon_centroid
from panelweave.operators.aggregates import widen
from panelweave.operators.distribution import rank_pct
from panelweave.operators.evaluation import permutation_importance
from panelweave.operators.periods import with_previous, with_previous_elections
from panelweave.plans.blocs import bloc_panel
from panelweave.sources import scan_projected, scan_year_filter

registry.load()
SF = "/root/testdata/sf0.001"


def plan(df):
    """Initial physical plan; shuffle joins are forced so that sizes do not hide exchanges."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = df.select("*")
        return fresh._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(text):
    return len(re.findall(r"\bExchange (?:hash|range|round|single)", text, re.I))


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    df = scan_projected(
        spark, f"{SF}/orders.parquet", ["o_custkey"], ["o_orderkey"], F.col("o_orderkey") > 10
    )
    text = plan(df)
    assert "GreaterThan(o_orderkey,10)" in text
    only_complete = plan(scan_projected(spark, f"{SF}/orders.parquet", ["o_custkey"], ["o_orderkey"]))
    assert "PushedFilters: [IsNotNull(o_orderkey)]" in only_complete
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text
    path = str(tmp_path / "y")
    views.votes_long(spark, SF).write.parquet(path)
    assert "GreaterThan(annee,1997)" in plan(scan_year_filter(spark, path, 1997))


def test_bloc_panel_exchanges_each_input_once(spark):
    ballots = spark.read.schema("annee int, codecommune string, nuance string, voix long").parquet(SF + "/nation.parquet")
    registered = ballots.selectExpr("annee", "codecommune", "voix as inscrits")
    panel = bloc_panel(ballots, registered, views.label_maps(spark))
    text = plan(panel)
    # one hash exchange per detail table; the label tables are the only broadcast
    detail = [m for m in re.findall(r"Exchange hashpartitioning\((\w+)#\d+, (\w+)#", text)]
    assert detail == [("annee", "codecommune")] * 2
    assert "BroadcastHashJoin" in text and "partial_sum" in text


def test_pivot_uses_one_exchange(spark):
    long = spark.range(10).selectExpr("cast(id as string) k", "'f' as n", "1.0D as v")
    assert exchanges(plan(widen(long, ["k"], "n", "v", ["f", "g"]))) == 1


def test_previous_values_use_one_exchange(spark):
    rows = spark.createDataFrame(
        [("a", "f", 2000, 1.0)], "codecommune string, feature string, annee int, value double"
    )
    assert exchanges(plan(with_previous(rows, "codecommune", ["feature"], "annee", ["value"]))) == 1
    votes = rows.selectExpr("codecommune", "feature election_type", "annee", "value inscrits", "value pvotex")
    assert exchanges(plan(with_previous_elections(votes, ["pvotex"]))) == 1


def test_a_centroid_computes_its_polygons_once(spark):
    rings = spark.read.schema("corners array<array<double>>").parquet(SF + "/nation.parquet")
    center = polygon_centroid(F.array(F.array("corners")))
    projected = [line for line in plan(rings.select(center.alias("c"))).splitlines() if "aggregate(" in line]
    assert projected and all(line.count("corners#") == 1 for line in projected)


def test_rank_sorts_once(spark):
    rows = spark.createDataFrame([("g", 1.0)], "g string, v double")
    text = plan(rank_pct(rows, ["g"], "v"))
    assert exchanges(text) == 1 and len(re.findall(r"\bSort \[", text)) == 1 and text.count("Window [") == 1


def test_importance_joins_on_row_numbers_before_multiplying_by_features(spark):
    test = spark.range(100).selectExpr("id k", "cast(id as double) x", "cast(-id as double) z", "cast(id as double) y")
    scorer = lambda d: d.withColumn("prediction", F.col("x"))
    text = plan(permutation_importance(scorer, test, ["k"], ["x", "z"], "y"))
    assert "Window [" not in text and "CartesianProduct" not in text and "BroadcastNestedLoop" not in text
    joins = re.findall(r"(?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[(\w+)", text)
    assert [j.split("#")[0] for j in joins] == ["_j"]
    # printed from the top: the features are laid out above the join, the repeats below it
    assert text.index("Generate explode([x,z]") < text.index("Join [_j")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_cartesian_product_and_no_global_window(spark, name):
    if name in {"grid_search_cv", "permutation_importance", "rf_predict", "feature_selection"}:
        pytest.skip("trains models; its relational parts are covered by other queries")
    text = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in text and "Join Cross" not in text
    for window in re.findall(r"windowspecdefinition\(([^()]*)", text):
        first = window.split(",")[0]
        assert " ASC" not in first and " DESC" not in first, f"window without partition keys: {window}"
