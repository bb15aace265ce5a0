"""Feature selection and model evaluation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from panelweave.operators.evaluation import Regression, permutation_importance, regression_metrics
from panelweave.operators.selection import (
    FeatureSelector,
    correlation_matrix,
    mutual_information,
    prune_by_vif,
    variance_inflation,
)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 2000
    a, b, noise = rng.normal(size=(3, n))
    pdf = pd.DataFrame({
        "id": range(n), "a": a, "b": b, "copy": a + 0.01 * rng.normal(size=n), "noise": noise,
        "constant": 1.0, "name": "x", "y": 3 * a + b + 0.1 * rng.normal(size=n),
    })
    pdf.loc[::10, "b"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    return pdf, df.cache()


def ols_vif(x):
    vifs = []
    for j in range(x.shape[1]):
        others = np.column_stack([np.ones(len(x)), np.delete(x, j, axis=1)])
        rest = x[:, j] - others @ np.linalg.lstsq(others, x[:, j], rcond=None)[0]
        vifs.append(((x[:, j] - x[:, j].mean()) ** 2).sum() / (rest**2).sum())
    return vifs


def test_vif_equals_ols(data):
    pdf, df = data
    columns = ["a", "copy", "noise"]
    got = variance_inflation(correlation_matrix(df, columns))
    np.testing.assert_allclose(got, ols_vif(pdf[columns].to_numpy()), rtol=1e-6)


def test_vif_edges(data):
    _, df = data
    assert variance_inflation(np.ones((1, 1))).tolist() == [1.0]
    corr = correlation_matrix(df, ["a", "constant", "noise"])
    vifs = variance_inflation(corr)
    assert np.isinf(vifs[1]) and vifs[0] == pytest.approx(vifs[2], rel=1e-6)
    assert prune_by_vif(corr, ["a", "constant", "noise"])[0] == ["a", "noise"]
    twin = np.array([[1.0, 1.0], [1.0, 1.0]])
    kept, dropped = prune_by_vif(twin, ["first", "second"])
    assert kept == ["second"] and dropped == [("first", np.inf)]


def test_information_orders_features(data):
    _, df = data
    scores = {r.feature: r.score for r in mutual_information(df, ["a", "noise", "constant"], "y").collect()}
    assert scores["a"] > 0.5 > 0.1 > scores["noise"] > scores["constant"] == 0.0


def test_selector_keeps_one_of_two_copies(data):
    _, df = data
    selector = FeatureSelector(n_mi=4).fit(df, ["id"], "y")
    assert len({"a", "copy"} & set(selector.selected_features)) == 1
    assert "name" not in selector.selected_features and "y" not in selector.selected_features
    assert selector.transform(df).columns == selector.selected_features


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5), (3.0, 2.5)], "y double, p double")
    row = regression_metrics(df, "y", "p").first()
    assert row["r2"] == pytest.approx(1 - 0.5 / 2)
    assert row["rmse"] == pytest.approx((0.5 / 3) ** 0.5)
    assert (row["y_std"], row["y_mean"]) == (pytest.approx((2 / 3) ** 0.5), 2.0)
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double")
    assert regression_metrics(flat, "y", "p").first()["r2"] == 0.0


def test_linear_importance_is_near_its_expectation(data):
    """Shuffling x of a scorer c*x lowers r2 by about 2 c cov(x, y) / var(y)."""
    pdf, df = data
    scorer = lambda d: d.withColumn("prediction", 3 * F.col("a") + 0 * F.col("noise"))
    found = {r.feature: r for r in permutation_importance(scorer, df, ["id"], ["a", "noise"], "y").collect()}
    expected = 2 * 3 * np.cov(pdf.a, pdf.y)[0, 1] / pdf.y.var()
    assert found["a"].importance_mean == pytest.approx(expected, rel=0.1)
    assert found["noise"].importance_mean == pytest.approx(0.0, abs=1e-12)


def test_fit_explain_and_tune(data):
    _, df = data
    runner = Regression(LinearRegression, maxIter=20)
    model, importances, metrics = runner.train_test_with_permutation_importance(
        df, ["id"], ["a", "noise"], "y", perm_n_repeats=3
    )
    assert metrics["r2"] > 0.8 and model is runner.model
    assert [r.feature for r in importances.collect()] == ["a", "noise"]
    best, results, params, score = runner.tune(
        df, ["id"], ["a", "noise"], "y", {"regParam": [0.0, 100.0]}, cv_splits=3
    )
    assert params == {"regParam": 0.0} and runner.params["regParam"] == 0.0 and best is runner.model
    rows = results.collect()
    assert [r.rank_test_score for r in rows] == [1, 2] and rows[0].mean_test_score == pytest.approx(score)
    none, _, _, error = Regression(LinearRegression).tune(
        df, ["id"], ["a", "noise"], "y", {"regParam": [0.0]}, cv_splits=2,
        scoring="neg_root_mean_squared_error", refit=False,
    )
    assert none is None and error < 0


def test_model_of_panel_prunes_years_and_columns(spark, tmp_path):
    from pyspark.ml.regression import LinearRegression

    from panelweave.operators.evaluation import Regression
    from panelweave.operators.selection import FeatureSelector
    from panelweave.plans.modelling import model_of_panel, modelling_rows

    rows = spark.range(400).selectExpr(
        "cast(id as string) as codecommune", "cast(1990 + id % 20 as int) as annee", "cast(id % 2 as int) as type",
        "cast(3 * (id % 37) + 2 as double) as share", "cast(id % 37 as double) as `a/b`",
        "case when id % 7 = 0 then null else cast(id % 11 as double) end as gappy",
        "case when id % 8 <> 1 then cast(1 as double) end as sparse", "'text' as named",
        "case when id % 50 = 10 then null else cast(id % 5 as double) end as target",
    )
    path = str(tmp_path / "panel")
    rows.write.parquet(path)
    prepared = modelling_rows(spark, path, "share", starting_year=1999, election_type=1, threshold=0.19)
    assert prepared.columns == ["codecommune", "annee", "share", "a/b", "gappy", "target"]
    assert prepared.count() == 100 and prepared.agg({"annee": "min"}).first()[0] == 2001
    assert prepared.filter("gappy is null").count() == 0

    found = model_of_panel(
        spark, path, Regression(LinearRegression, solver="normal"), "share", selector=FeatureSelector(n_mi=1), starting_year=1999, election_type=1
    )
    assert found.selected == ["a/b"] and found.metrics["r2"] > 0.999
    assert [r["feature"] for r in found.importances.collect()] == ["a/b"]
    # rows without a target take no part
    assert modelling_rows(spark, path, "target", starting_year=1999, election_type=0).count() == 96
    with pytest.raises(ValueError, match="absent"):
        modelling_rows(spark, path, "absent")
    with pytest.raises(ValueError, match="no numeric feature"):
        rows.select("codecommune", "annee", "type", "share").write.parquet(path + "-bare")
        model_of_panel(spark, path + "-bare", Regression(LinearRegression), "share")
