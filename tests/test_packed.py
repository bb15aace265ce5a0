"""Packed panels against pandas, and augmentation group by group against the whole."""

import random
from dataclasses import replace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelweave.operators import packed
from panelweave.operators.augment import augment
from panelweave.operators.incremental import refreshed_augmentation
from panelweave.storage import new_path

KINDS = ["raw", "rank", "winsor", "delta", "lag", "pct_change", "lagwinsor"]


def long_table(spark, rows):
    return spark.createDataFrame(rows, "k string, y int, `a label` string, v double")


def test_packed_rows_keep_the_rules_of_widening(spark):
    rows = [("a", 1, "x", 1.0), ("a", 1, "y", None), (None, 1, "x", 2.0), (None, 1, "z.z", 3.0), ("b", 1, None, 4.0), ("b", 1, None, 5.0)]
    panel = packed.pack(long_table(spark, rows), ["k"], "a label", "v")
    assert [tuple(r) for r in panel.labels.orderBy("id").collect()] == [(0, "x"), (1, "y"), (2, "z.z")]
    found = {r["k"]: [tuple(c) for c in r["cells"]] for r in panel.rows.collect()}
    assert found == {"a": [(0, 1.0)], None: [(0, 2.0), (2, 3.0)], "b": []}
    wide = {r["k"]: (r["z.z"], r["x"]) for r in packed.with_columns(panel, ["z.z", "x"]).collect()}
    assert wide == {"a": (None, 1.0), None: (3.0, 2.0), "b": (None, None)}
    with pytest.raises(ValueError):
        packed.with_columns(panel, ["x", "none"])
    with pytest.raises(PySparkException):
        packed.pack(long_table(spark, [*rows, ("a", 1, "x", 7.0)]), ["k"], "a label", "v").rows.collect()


def test_packed_panel_without_rows(spark):
    panel = packed.pack(long_table(spark, []), ["k", "y"], "a label", "v")
    assert panel.rows.count() == panel.labels.count() == packed.unpack(panel).count() == 0
    assert packed.missing_rates(panel).count() == packed.correlations(replace(panel, rows=panel.rows.withColumn("t", F.lit(1.0))), "t").count() == 0


def test_chosen_labels_are_all_that_is_read(spark):
    rows = [(f"k{i}", 1, f"l{j}", float(i * j)) for i in range(20) for j in range(1, 6) if i % j == 0]
    panel = packed.pack(long_table(spark, rows), ["k"], "a label", "v")
    rates = {r["label"]: (r["filled"], r["missing"]) for r in packed.missing_rates(panel).collect()}
    assert rates["l1"] == (20, 0.0) and rates["l3"] == (7, pytest.approx(0.65))
    kept = packed.keep_by_missing(panel, 0.6)
    assert sorted({r["label"] for r in packed.unpack(kept).collect()}) == ["l1", "l2"]
    rows_with_target = kept.rows.withColumn("t", F.substring("k", 2, 9).cast("double"))
    found = {r["label"]: r["correlation"] for r in packed.correlations(replace(kept, rows=rows_with_target), "t").collect()}
    assert found == {"l1": pytest.approx(1.0), "l2": pytest.approx(1.0)}


def test_labels_beyond_any_column_limit(spark):
    """30,000 labels, and a dictionary that is joined rather than broadcast gives the same rows."""
    cells = spark.range(90_000).select(
        (F.col("id") % 7).cast("string").alias("k"), F.lit(1).alias("y"), F.concat(F.lit("l"), F.col("id") % 30_000).alias("a label"), F.col("id").cast("double").alias("v")
    )
    panel = packed.pack(cells, ["k"], "a label", "v")
    assert panel.labels.count() == 30_000
    back = {(r["k"], r["label"], r["v"]) for r in packed.unpack(panel).withColumnRenamed("value", "v").collect()}
    assert back == {(str(i % 7), f"l{i % 30_000}", float(i)) for i in range(90_000)}


def test_as_of_takes_one_year_a_label(spark):
    rows = [("a", 1990, "x", 1.0), ("b", 1993, "x", 2.0), ("a", 1991, "y", 3.0), ("a", 1800, "old", 4.0)]
    panel = packed.pack(long_table(spark, rows), ["k", "y"], "a label", "v")
    served = packed.as_of(panel, "y", spark.createDataFrame([(1992,), (1994,), (None,)], "target int"), max_past=5)
    found = sorted(tuple(r) for r in packed.unpack(served).select("k", "y", "label", "value").collect())
    assert found == [("a", 1992, "x", 1.0), ("a", 1992, "y", 3.0), ("a", 1994, "y", 3.0), ("b", 1994, "x", 2.0)]


def raw(spark, table):
    return spark.createDataFrame([(c, f, y, v) for (c, f, y), v in table.items()], "codecommune string, feature string, annee int, value double")


def as_set(df):
    return sorted(repr(tuple(r)) for r in df.select("codecommune", "feature", "annee", *KINDS).collect())


def random_group(rng, feature, year):
    return {(f"c{i}", feature, year): rng.choice([None, rng.randrange(5) * 1.0, rng.random()]) for i in rng.sample(range(12), 8)}


def test_groups_that_changed_are_all_that_is_computed(spark):
    rng = random.Random(3)
    table = {}
    for feature in "fg":
        for year in (1990, 1993, 1995, 1999, 2004):
            table.update(random_group(rng, feature, year))
    folder = new_path(spark, "augmented")

    def without(feature, year):
        return {k: v for k, v in table.items() if k[1:] != (feature, year)}

    def step(expected):
        df = raw(spark, table)
        found = refreshed_augmentation(spark, folder, "k", df, KINDS)
        assert as_set(found.rows) == as_set(augment(df, KINDS))
        assert {tuple(r) for r in found.computed.collect()} == expected

    step({(f, y) for f in "fg" for y in (1990, 1993, 1995, 1999, 2004)})
    step(set())  # nothing new
    table.update(random_group(rng, "f", 1997))  # a year between two others
    step({("f", 1997), ("f", 1999)})
    table.update(random_group(rng, "g", 2010))  # a year behind all others
    step({("g", 2010)})
    table = without("f", 1990)  # the first year of one feature is gone
    step({("f", 1990), ("f", 1993)})
    table = {**without("g", 1995), **random_group(rng, "f", 2001)}
    step({("g", 1995), ("g", 1999), ("f", 2001), ("f", 2004)})
    key = next(k for k in table if k[1:] == ("g", 1993))
    table[key] = 77.0  # one value put right
    step({("g", 1993), ("g", 1999)})
    table = {}
    found = refreshed_augmentation(spark, folder, "k", raw(spark, table), KINDS)
    assert found.rows.count() == 0


def test_augmentation_of_nothing(spark):
    found = refreshed_augmentation(spark, new_path(spark, "augmented"), "k", raw(spark, {}), KINDS)
    assert found.rows.count() == 0 and found.rows.columns == ["codecommune", "feature", "annee", *KINDS]
