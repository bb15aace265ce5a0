"""Hand-computed edge cases of missing values, ties, zeros and repeated keys."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelweave.fixed_values import CITY_DISTRICTS
from panelweave.functions import (
    gini_simpson,
    move_year_to_end,
    not_in,
    parse_vote_column,
    ratio_or_zero,
    relative_change,
    share_or_zero,
    with_default_year,
)
from panelweave.functions.geometry import geometry_polygons, polygon_centroid
from panelweave.operators.aggregates import only_value, sum_by, value_counts, widen
from panelweave.operators.asof import resolve_years
from panelweave.operators.columns import drop_sparse, dropna_with_counts, missing_profile
from panelweave.operators.distribution import quantiles, rank_pct, winsorize
from panelweave.operators.joins import (
    join_null_safe,
    join_one_to_one,
    lookup_join,
    semi_keep_null,
    set_difference,
)
from panelweave.operators.labels import last_wins, lookup
from panelweave.operators.periods import with_previous, with_previous_elections
from panelweave.operators.places import explode_districts


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


@pytest.mark.parametrize("rows_per_task", [1_000_000, 1])
def test_average_tie_rank(spark, rows_per_task):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, None), (5, 9.0)], "id int, v double")
    ranked = rank_pct(df.withColumn("g", F.lit("x")), ["g"], "v", rows_per_task=rows_per_task)
    assert dict(values(ranked, "id", "rank_pct")) == {1: 0.25, 2: 0.625, 3: 0.625, 4: None, 5: 1.0}


@pytest.mark.parametrize("rows_per_task", [1_000_000, 1])
def test_interpolated_quantiles(spark, rows_per_task):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", None), ("b", None)], "g string, v double"
    )
    found = quantiles(df, ["g"], "v", [0.01, 0.25, 0.99], ["l", "m", "h"], rows_per_task)
    rows = {r["g"]: (r["l"], r["m"], r["h"]) for r in found.collect()}
    assert rows["a"] == pytest.approx((1.02, 1.5, 3.96))
    assert rows["b"] == (None, None, None)


def test_winsor_keeps_missing_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None)], "g string, v double")
    clipped = [r["winsor"] for r in winsorize(df, ["g"], "v").collect()]
    assert sorted(v for v in clipped if v is not None) == pytest.approx([1.01, 1.99])
    assert clipped.count(None) == 1


def test_full_outer_join_matches_missing_keys(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, l int")
    right = spark.createDataFrame([(None, 4), ("a", 5), ("z", 6)], "k string, r int")
    joined = join_null_safe(left, right, ["k"], "full")
    assert set(values(joined, "k", "l", "r")) == {("a", 1, 5), (None, 2, 4), ("b", 3, None), ("z", None, 6)}


def test_not_in_strict_and_lenient(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    assert values(df.filter(not_in(F.col("k"), ["a"], False)), "k") == ["b"]
    assert set(values(df.filter(not_in(F.col("k"), ["a"], True)), "k")) == {None, "b"}


def test_sum_of_missing_is_zero_and_missing_keys_go(spark):
    df = spark.createDataFrame(
        [("a", None, "x"), ("a", None, None), (None, 3, "y"), ("b", 2, None)], "k string, v int, d string"
    )
    assert set(values(sum_by(df, ["k"], ["v"], ["d"]), "k", "v", "d")) == {("a", 0, "x"), ("b", 2, None)}


def test_guarded_ratios(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0), (3.0, 2.0, 2.0), (3.0, None, None)], "v double, t double, p double")
    row = df.select(
        share_or_zero(F.col("v"), F.col("t")).alias("share"),
        ratio_or_zero(F.col("v"), F.col("t")).alias("ratio"),
        relative_change(F.col("v"), F.col("p")).alias("change"),
    ).collect()
    assert [tuple(r) for r in row] == [(0.0, 0.0, None), (1.5, 1.5, 0.5), (0.0, None, None)]


def test_gini_skips_missing_parts(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (3.0, None, 3.0), (0.0, 0.0, 0.0)], "a double, b double, t double")
    assert values(df.select(gini_simpson(["a", "b"], F.col("t")).alias("g")), "g") == [0.5, 0.0, 1.0]


def test_repeated_label_key_last_wins_even_if_missing(spark):
    table = spark.createDataFrame([(1, "x", "A"), (2, "x", None), (3, "y", "B")], "p int, k string, v string")
    unique = last_wins(table, "k", "v", "p")
    assert set(values(unique, "k", "v")) == {("x", None), ("y", "B")}
    other = spark.createDataFrame([("x", "C"), ("y", "D")], "k string, v string")
    codes = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "k string")
    labelled = lookup(codes, [unique, other], "k", "v", "label")
    assert set(values(labelled, "k", "label")) == {("x", "C"), ("y", "B"), ("z", None), (None, None)}


def test_one_to_one_join_rejects_repeats(spark):
    once = spark.createDataFrame([("a", 1), (None, 2)], "k string, l int")
    twice = spark.createDataFrame([(None, 1), (None, 2)], "k string, r int")
    good = spark.createDataFrame([(None, 1), ("c", 2)], "k string, r int")
    assert set(values(join_one_to_one(once, good, ["k"]), "k", "l", "r")) == {("a", 1, None), (None, 2, 1)}
    for left, right in ((once, twice), (twice.withColumnRenamed("r", "l"), good)):
        with pytest.raises(PySparkException, match="more than one row"):
            join_one_to_one(left, right, ["k"]).collect()


def test_widen_rejects_two_values_for_a_cell(spark):
    long = spark.createDataFrame([("a", "f", 1.0), ("a", "f", 1.0)], "k string, n string, v double")
    with pytest.raises(PySparkException, match="two rows for one cell"):
        widen(long, ["k"], "n", "v").collect()


def test_repeated_period_is_an_error(spark):
    twice = spark.createDataFrame(
        [("a", "f", 2000, 1.0), ("a", "f", 2000, 2.0)], "codecommune string, feature string, annee int, value double"
    )
    with pytest.raises(PySparkException, match="two rows"):
        with_previous(twice, "codecommune", ["feature"], "annee", ["value"]).collect()


def test_feature_names(spark):
    df = spark.createDataFrame([("pop1999h",), ("x1999_2004z",), ("pop1999",), ("pop",), ("a1999b2004",)], "n string")
    assert values(df.select(move_year_to_end(F.col("n")).alias("m")), "m") == [
        "poph1999", "x_z1999", "pop1999", "pop", "a1999b2004"
    ]
    named = df.select(with_default_year(F.col("n"), 1975, ("pop",)).alias("m"))
    assert values(named, "m")[3:] == ["pop", "a1999b2004_1975"]
    vote = spark.createDataFrame([("pvoteCD2012bis-legislative",)], "n string").select(
        parse_vote_column(F.col("n")).alias("v")
    ).first()["v"]
    assert tuple(vote) == ("CD", 2012, "bis", "legislative")


def test_asof_never_later_and_within_five_years(spark):
    catalog = spark.createDataFrame(
        [("a", 2001), ("a", 1999), ("b", 1996), ("c", 1995), ("d", 2002)], "feature string, annee int"
    )
    targets = spark.createDataFrame([(2001,)], "target int")
    assert set(values(resolve_years(catalog, targets), "feature", "annee")) == {("a", 2001), ("b", 1996)}


def test_previous_uses_catalog_years_not_own_rows(spark):
    rows = [("a", "f", 1990, 1.0), ("a", "f", 2000, 4.0), ("b", "f", 1990, 2.0), ("c", "f", 1995, 7.0),
            ("d", "f", 1995, None), ("d", "f", 2000, 3.0)]
    df = spark.createDataFrame(rows, "codecommune string, feature string, annee int, value double")
    found = with_previous(df, "codecommune", ["feature"], "annee", ["value"])
    assert set(values(found, "codecommune", "annee", "value", "prev_value")) == {
        ("a", 1990, 1.0, None), ("a", 1995, None, 1.0), ("a", 2000, 4.0, None),
        ("b", 1990, 2.0, None), ("b", 1995, None, 2.0),
        ("c", 1995, 7.0, None), ("c", 2000, None, 7.0),
        ("d", 1995, None, None), ("d", 2000, 3.0, None),
    }


def test_previous_elections_skip_absent_years(spark):
    rows = [("a", "t", 1, 10.0), ("a", "t", 3, 30.0), ("b", "t", 1, 1.0), ("b", "t", 2, 2.0), ("b", "t", 3, 3.0)]
    votes = spark.createDataFrame(
        [(c, t, y, 1.0, v) for c, t, y, v in rows],
        "codecommune string, election_type string, annee int, inscrits double, pvotex double",
    )
    found = with_previous_elections(votes, ["pvotex"]).filter("annee = 3")
    assert set(values(found, "codecommune", "pvotepreviousx", "pvotepreviouspreviousx")) == {
        ("a", None, 10.0), ("b", 2.0, 1.0)
    }


def test_sparse_columns(spark):
    df = spark.createDataFrame(
        [(1, None, None), (2, None, None), (3, 1, None), (4, 1, 1)], "id int, two int, three int"
    )
    kept, dropped = drop_sparse(df)
    assert kept.columns == ["id", "two"] and dropped == ["three"]
    assert drop_sparse(df, 0.49, strict=False)[0].columns == ["id"]
    assert drop_sparse(df, 0.5, strict=False)[0].columns == ["id", "two"]
    assert set(values(missing_profile(df), "column", "missing", "rate")) == {
        ("id", 0, 0.0), ("two", 2, 0.5), ("three", 3, 0.75)
    }


def test_drop_counts_are_sequential(spark):
    df = spark.createDataFrame([(None, None), (None, 1), (1, None), (1, 1)], "a int, b int")
    kept, counts = dropna_with_counts(df, ["a", "b"])
    assert values(kept, "a", "b") == [(1, 1)]
    assert values(counts, "column", "dropped") == [("a", 2), ("b", 1)]


def test_semi_join_keeps_missing_keys(spark):
    left = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    right = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert set(values(semi_keep_null(left, right, "k"), "k")) == {"a", None}
    assert values(set_difference(left, right, "k"), "k") == ["b"]


def test_value_counts_has_a_missing_bucket(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "k string")
    assert values(value_counts(df, "k"), "k", "n") == [("a", 2), (None, 1)]


@pytest.mark.parametrize("max_rows", [100, 0])
def test_lookup_join_broadcast_and_salted_agree(spark, max_rows):
    df = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(300)], "id int, k string")
    table = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    joined = lookup_join(df, table, ["k"], max_rows)
    assert joined.count() == 300
    assert joined.filter("k = 'hot' and v = 1").count() == 200
    assert joined.filter("k is null and v is null").count() == 100


def test_city_districts(spark):
    df = spark.createDataFrame([("13055", 1), ("69123", 2), ("75056", 3), ("01001", 4)], "codecommune string, x int")
    rows = set(values(explode_districts(df, CITY_DISTRICTS), "codecommune", "x"))
    assert len(rows) == 4 + 16 + 9 + 20
    assert {("13201", 1), ("13216", 1), ("69381", 2), ("69389", 2), ("75101", 3), ("75120", 3)} <= rows


def centroid(spark, kind, coordinates):
    df = spark.createDataFrame([(kind, str(coordinates))], "kind string, c string")
    c = df.select(polygon_centroid(geometry_polygons(F.col("kind"), F.col("c"))).alias("p")).first()["p"]
    return c and (c["x"], c["y"])


def test_centroids(spark):
    square = [[0, 0], [4, 0], [4, 2], [0, 2], [0, 0]]
    assert centroid(spark, "Polygon", [square]) == pytest.approx((2, 1))
    assert centroid(spark, "Polygon", [square[::-1]]) == pytest.approx((2, 1))
    hole = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    for h in (hole, hole[::-1]):
        assert centroid(spark, "Polygon", [square, h]) == pytest.approx((3, 1))
    far = [[10, 0], [14, 0], [14, 2], [10, 2], [10, 0]]
    assert centroid(spark, "MultiPolygon", [[square], [far]]) == pytest.approx((7, 1))
    assert centroid(spark, "Polygon", [[[1, 1], [2, 2], [1, 1]]]) is None


def test_only_value_keeps_a_missing_cell_missing(spark):
    df = spark.createDataFrame([("a", None)], "k string, v double")
    assert df.groupBy("k").agg(only_value("v", "t").alias("v")).first()["v"] is None
