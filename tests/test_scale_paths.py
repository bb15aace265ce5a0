"""The ways taken beyond one task's share give the same rows as the short ways."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.operators import distribution
from panelweave.operators.augment import augment
from panelweave.operators.distribution import quantiles, rank_pct
from panelweave.operators.sampling import hash_cuts, kfold, row_token, sample_capped, split_train_test


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most rows; a third of its values equal, a tenth missing."""
    rng = np.random.default_rng(7)
    n = 6000
    value = np.where(rng.random(n) < 0.33, 5.0, rng.normal(5, 40, n).round(3))
    value[rng.random(n) < 0.1] = np.nan
    pdf = pd.DataFrame({"id": range(n), "g": np.where(rng.random(n) < 0.8, "big", "small"), "v": value})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return pdf, df


def test_sliced_rank_equals_pandas(skewed):
    pdf, df = skewed
    want = pdf.groupby("g")["v"].rank(pct=True)
    for rows_per_task in (10**6, 100):
        got = rank_pct(df, ["g"], "v", rows_per_task=rows_per_task).toPandas().set_index("id")["rank_pct"]
        pd.testing.assert_series_equal(got.sort_index(), want, check_names=False)


@pytest.mark.parametrize("rows_per_task", [10**6, 100])
def test_banded_quantiles_equal_pandas(skewed, rows_per_task):
    pdf, df = skewed
    probabilities = [0.0, 0.01, 0.4, 0.5, 0.99, 1.0]
    names = [f"q{i}" for i in range(6)]
    got = quantiles(df, ["g"], "v", probabilities, names, rows_per_task).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["v"].quantile(probabilities).unstack()
    np.testing.assert_allclose(got[names].to_numpy(), want.to_numpy(), rtol=1e-12)
    short = quantiles(df, ["g"], "v", probabilities, names).toPandas().set_index("g").sort_index()
    pd.testing.assert_frame_equal(got, short, check_exact=True)


def test_quantiles_survive_a_wrong_sketch(skewed, monkeypatch):
    """Bands that miss their quantile are noticed and read again in full."""
    pdf, df = skewed
    monkeypatch.setattr(distribution, "_BAND", -0.2)
    got = quantiles(df, ["g"], "v", [0.5], ["m"], rows_per_task=100).toPandas().set_index("g")["m"]
    pd.testing.assert_series_equal(got.sort_index(), pdf.groupby("g")["v"].median(), check_names=False)


def test_augment_on_both_paths(spark, skewed):
    _, df = skewed
    long = df.select(
        F.col("id").cast("string").alias("codecommune"), F.lit("f").alias("feature"),
        F.explode(F.array(F.lit(1990), F.lit(2000))).alias("annee"), F.col("v").alias("value"),
    )
    kinds = ["raw", "rank", "winsor", "delta", "lagwinsor", "pct_changewinsor"]
    short, sliced = (
        augment(long, kinds, rows).toPandas().sort_values(["codecommune", "annee"], ignore_index=True)
        for rows in (10**6, 500)
    )
    pd.testing.assert_frame_equal(short, sliced)


def test_cuts_descend_into_crowded_prefixes(spark, monkeypatch):
    monkeypatch.setattr("panelweave.operators.sampling._FETCH_ROWS", 0)
    df = spark.range(3000).withColumnRenamed("id", "k")
    token = row_token(["k"])
    rows, cuts = hash_cuts(df, token, lambda n: [1, 700, n])
    ordered = sorted(r[0] for r in df.select(token).collect())
    assert rows == 3000
    assert cuts == {1: ordered[0], 700: ordered[699], 3000: ordered[-1]}


def test_samples_splits_and_folds_have_exact_sizes(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    assert sample_capped(df, ["k"], 100).count() == 100
    assert sample_capped(df, ["k"], 5000).count() == 1003
    train, test = split_train_test(df, ["k"])
    assert (train.count(), test.count()) == (852, 151)
    assert train.join(test, "k").isEmpty()
    sizes = sorted(r["count"] for r in kfold(df, ["k"]).groupBy("fold").count().collect())
    assert sizes == [200, 200, 201, 201, 201]
    other = sample_capped(df, ["k"], 100, seed=1)
    assert other.join(sample_capped(df, ["k"], 100), "k").count() < 100
