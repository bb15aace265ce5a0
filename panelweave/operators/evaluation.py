"""Fit, score and explain regressors on distributed rows."""

from __future__ import annotations

from collections.abc import Callable
from math import gcd
from multiprocessing.pool import ThreadPool
from statistics import fmean, pstdev

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.fixed_values import CV_FOLDS, PERMUTATION_REPEATS, RANDOM_SEED, TEST_FRACTION
from panelweave.operators.columns import quoted
from panelweave.operators.moments import fold_scores, products_by_fold, rows_of_equal_products, score
from panelweave.operators.ordering import number_in_order
from panelweave.operators.sampling import kfold, row_token, split_train_test
from panelweave.storage import stage

_STEP_A, _STEP_B = 7_919, 104_729
SCORINGS = {
    "r2": "r2",
    "neg_root_mean_squared_error": "rmse",
    "neg_mean_squared_error": "mse",
    "neg_mean_absolute_error": "mae",
}


def _score(y: Column, yhat: Column, scoring: str) -> Column:
    """Aggregate whose larger values are better."""
    error = y - yhat
    if scoring == "r2":
        unexplained = F.sum(error * error)
        spread = F.var_pop(y) * F.count(y)
        return F.when(spread != 0, F.lit(1.0) - unexplained / spread).otherwise(
            F.when(unexplained == 0, F.lit(1.0)).otherwise(F.lit(0.0))
        )
    if scoring == "neg_root_mean_squared_error":
        return -F.sqrt(F.avg(error * error))
    if scoring == "neg_mean_squared_error":
        return -F.avg(error * error)
    if scoring == "neg_mean_absolute_error":
        return -F.avg(F.abs(error))
    raise ValueError(f"unknown scoring {scoring!r}; known: {sorted(SCORINGS)}")


def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """One row: r2, rmse, population standard deviation and mean of the target."""
    truth, guess = F.col(quoted(y)).cast("double"), F.col(quoted(yhat)).cast("double")
    return df.agg(
        _score(truth, guess, "r2").alias("r2"),
        F.sqrt(F.avg((truth - guess) * (truth - guess))).alias("rmse"),
        F.stddev_pop(truth).alias("y_std"),
        F.avg(truth).alias("y_mean"),
    )


def permutation_step(rows: int, repeat: int, seed: int = RANDOM_SEED) -> tuple[int, int]:
    """(a, b) of a repeat; a is the first number from a start on that shares no factor with ``rows``."""
    rows = max(rows, 1)
    turn = seed + repeat + 1
    a = max(1, turn * _STEP_A % rows)
    while gcd(a, rows) != 1:
        a += 1
    return a, turn * _STEP_B % rows


def permutation_importance(
    predict: Callable[[DataFrame], DataFrame],
    test: DataFrame,
    keys: list[str],
    features: list[str],
    target: str,
    repeats: int = PERMUTATION_REPEATS,
    seed: int = RANDOM_SEED,
    scoring: str = "r2",
) -> DataFrame:
    """(feature, importance_mean, importance_std): score lost by shuffling it.

    ``predict`` adds a ``prediction`` column to rows that have ``features``.
    Rows are numbered in a random order.  In repeat r row i takes the feature
    values of row (a * i + b) mod n, with a coprime to n: a permutation of the
    whole test set, found by an equi-join on the row number, the same way at
    every size.  All features share the permutation of a repeat, each being
    replaced alone when scored.
    """
    columns = [F.col(quoted(c)) for c in features]
    base = test.select(row_token(keys, seed).alias("_t"), F.col(quoted(target)).alias("_y"), *columns)
    numbered = stage(number_in_order(base, ["_t"], "_i", start=0).drop("_t"), "numbered")
    before, rows = predict(numbered).agg(
        _score(F.col("_y"), F.col("prediction"), scoring), F.count(F.lit(1))
    ).first()
    steps = [permutation_step(rows, r, seed) for r in range(repeats)]
    partner = F.element_at(F.array(*[F.lit(a).cast("long") for a, _ in steps]), F.col("_repeat") + 1) * F.col("_i") + F.element_at(
        F.array(*[F.lit(b).cast("long") for _, b in steps]), F.col("_repeat") + 1
    )
    dealt = numbered.withColumn("_repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn(
        "_j", partner % F.lit(max(rows, 1))
    )
    others = numbered.select(F.col("_i").alias("_j"), F.struct(*columns).alias("_other"))
    moved = dealt.join(others, "_j")
    shuffled = moved.withColumn("_feature", F.explode(F.array(*[F.lit(f) for f in features]))).select(
        "_repeat",
        "_feature",
        "_y",
        *[
            F.when(F.col("_feature") == c, F.col("_other")[c]).otherwise(F.col(quoted(c))).alias(c)
            for c in features
        ],
    )
    scores = predict(shuffled).groupBy("_feature", "_repeat").agg(
        _score(F.col("_y"), F.col("prediction"), scoring).alias("s")
    )
    drop = F.lit(before) - F.col("s")
    return (
        scores.groupBy(F.col("_feature").alias("feature"))
        .agg(F.avg(drop).alias("importance_mean"), F.stddev_pop(drop).alias("importance_std"))
        .orderBy(F.desc("importance_mean"), "feature")
    )


class Regression:
    """Any ``pyspark.ml`` regressor class with its parameters.

    ``keys`` passed to the methods must identify a row; they make splits,
    folds and shuffles reproducible.
    """

    def __init__(self, base: type, **params):
        self.base = base
        self.params = dict(params)
        self.model = None

    def _estimator(self, features: list[str], target: str):
        """Unfitted assembler + regressor, and the regressor inside it."""
        regressor = self.base(featuresCol="_features", labelCol=target, **self.params)
        assembler = VectorAssembler(inputCols=features, outputCol="_features")
        return Pipeline(stages=[assembler, regressor]), regressor

    def fit(self, df: DataFrame, features: list[str], target: str) -> Regression:
        """Discard any earlier fit and train on ``df``."""
        self.model = self._estimator(features, target)[0].fit(
            df.select(*[F.col(quoted(c)) for c in [*features, target]])
        )
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with a ``prediction`` column."""
        scored = self.model.transform(df)
        return scored.select(*[F.col(quoted(c)) for c in df.columns], "prediction")

    def train_test_with_permutation_importance(
        self,
        df: DataFrame,
        keys: list[str],
        features: list[str],
        target: str,
        test_size: float = TEST_FRACTION,
        random_state: int = RANDOM_SEED,
        perm_n_repeats: int = PERMUTATION_REPEATS,
        perm_scoring: str = "r2",
    ):
        """(fitted model, importances, metrics of the held-out rows).

        The rows are written once: cuts, fit, metrics and shuffles each read them.
        """
        df = stage(df.select(*[F.col(quoted(c)) for c in dict.fromkeys([*keys, *features, target])]), "labelled")
        train, test = split_train_test(df, keys, test_size, random_state)
        if "seed" in self.params:
            self.params["seed"] = random_state
        self.fit(train, features, target)
        metrics = regression_metrics(self.predict(test), target, "prediction").first().asDict()
        importances = permutation_importance(
            self.predict, test, keys, features, target, perm_n_repeats, random_state, perm_scoring
        )
        return self.model, importances, metrics

    def _plain_linear(self, points: list[dict], scoring: str) -> bool:
        """Whether a fit and its score read nothing of the rows but sums of products."""
        known = {"maxIter", "tol", "solver", "standardization", "regParam", "elasticNetParam"}
        settings = [{**self.params, **point} for point in points]
        return (
            self.base is LinearRegression
            and scoring != "neg_mean_absolute_error"
            and all(set(s) <= known and s.get("solver") != "l-bfgs" for s in settings)
        )

    def _some_lasso(self, points: list[dict]) -> bool:
        return any({**self.params, **point}.get("elasticNetParam") for point in points)

    def _from_products(self, points: list[dict], scoring: str) -> bool:
        """Whether sums of products give the same scores as fitting would."""
        return self._plain_linear(points, scoring) and not self._some_lasso(points)

    def _from_few_rows(self, points: list[dict], scoring: str) -> bool:
        """Whether some point needs a search, which a few rows of equal products can serve."""
        return self._plain_linear(points, scoring) and self._some_lasso(points)

    def _scores_from_products(self, folded, features, target, points, scoring, parallelism) -> list[list[float]]:
        products = products_by_fold(folded, features, target, "fold")
        settings = [{**self.params, **point} for point in points]
        total = sum(products.values())

        def by_fitting(setting_and_fold) -> float:
            setting, own = setting_and_fold
            rows = [(Vectors.dense(r[:-1]), float(r[-1])) for r in rows_of_equal_products(total - own)]
            model = LinearRegression(**setting).fit(folded.sparkSession.createDataFrame(rows, ["features", "label"]).coalesce(1))
            return float(score(own, np.array([model.intercept, *model.coefficients, -1.0]), scoring))

        def scores(s: dict) -> list[float]:
            if s.get("regParam") and s.get("elasticNetParam"):  # no closed form: Spark's own search, on a few rows
                return pool.map(by_fitting, [(s, own) for own in products.values()], chunksize=1)
            return fold_scores(products, s.get("regParam", 0.0), scoring, s.get("standardization", True))

        with ThreadPool(parallelism) as pool:
            return [scores(s) for s in settings]

    def _scores_by_fitting(self, folded, estimator, grid, target, cv_splits, scoring, parallelism) -> list[list[float]]:
        evaluator = RegressionEvaluator(labelCol=target, metricName=SCORINGS[scoring])
        sign = 1.0 if scoring == "r2" else -1.0

        def fold_score(point_and_fold) -> float:
            point, fold = point_and_fold
            model = estimator.fit(folded.filter(F.col("fold") != fold), point)
            return sign * float(evaluator.evaluate(model.transform(folded.filter(F.col("fold") == fold))))

        folds = range(cv_splits)
        with ThreadPool(parallelism) as pool:  # each thread only starts Spark jobs
            flat = pool.map(fold_score, [(point, fold) for point in grid for fold in folds], chunksize=1)
        return [flat[i * cv_splits : (i + 1) * cv_splits] for i in range(len(grid))]

    def tune(
        self,
        df: DataFrame,
        keys: list[str],
        features: list[str],
        target: str,
        param_grid: dict[str, list],
        cv_splits: int = CV_FOLDS,
        scoring: str = "r2",
        random_state: int = RANDOM_SEED,
        refit: bool = True,
        parallelism: int = 4,
    ):
        """Grid search over shuffled folds.

        Returns (best model or None, results, best parameters, best score).
        Results have one row per grid point: parameters, mean and population
        standard deviation of the fold scores, rank, and the scores by fold.

        A grid of plain linear models is scored from one pass over the rows;
        any other estimator is fitted for every point and fold.
        """
        if scoring not in SCORINGS:
            raise ValueError(f"unknown scoring {scoring!r}; known: {sorted(SCORINGS)}")
        estimator, regressor = self._estimator(features, target)
        builder = ParamGridBuilder()
        for name, values in param_grid.items():
            builder = builder.addGrid(regressor.getParam(name), values)
        grid = builder.build()
        folded = kfold(df, keys, cv_splits, random_state).select(
            *[F.col(quoted(c)) for c in [*features, target]], "fold"
        )
        points = [{p.name: v for p, v in point.items()} for point in grid]
        if self._from_products(points, scoring) or self._from_few_rows(points, scoring):
            scores = self._scores_from_products(folded, features, target, points, scoring, parallelism)
        else:
            folded = stage(folded, "folded")
            scores = self._scores_by_fitting(folded, estimator, grid, target, cv_splits, scoring, parallelism)
        means = [fmean(s) for s in scores]
        rows = [
            (
                *[str(point[name]) for name in param_grid],
                mean,
                pstdev(by_fold),
                1 + sum(bool(other > mean) for other in means),
                by_fold,
            )
            for point, mean, by_fold in zip(points, means, scores)
        ]
        names = [f"param_{name} string" for name in param_grid]
        schema = ", ".join([*names, "mean_test_score double", "std_test_score double", "rank_test_score int", "fold_scores array<double>"])
        results = df.sparkSession.createDataFrame(rows, schema).orderBy("rank_test_score")
        best = max(range(len(points)), key=lambda i: means[i])
        if refit:
            self.params.update(points[best])
            self.model = estimator.fit(folded, grid[best])
        return (self.model if refit else None), results, points[best], means[best]
