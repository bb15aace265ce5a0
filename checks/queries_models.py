"""Sampling, feature selection and model evaluation."""

from __future__ import annotations

from math import isinf

from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from checks import views
from checks.registry import query, rounded
from checks.views import FEATURES
from panelweave.operators.evaluation import (
    Regression,
    permutation_importance as importances,
    regression_metrics as metrics_of,
)
from panelweave.operators.distribution import impute_medians
from panelweave.operators.sampling import kfold, sample_capped as capped, split_train_test
from panelweave.operators.neighbours import neighbour_information
from panelweave.operators.selection import (
    FeatureSelector,
    correlation_matrix,
    mutual_information,
    prune_by_vif,
    top_k,
    variance_inflation,
)


@query("select row_id, round(f_discount, 6) as f_discount, round(f_qty, 6) as f_qty from ml_filled")
def median_impute(spark, sf):
    filled = impute_medians(views.stored(views.ml_matrix, spark, sf), FEATURES)
    return rounded(filled.select("row_id", "f_discount", "f_qty"), "f_discount", "f_qty")


@query("select row_id, round(y, 6) as y from ml_ordered where place <= 5000")
def sample_capped(spark, sf):
    return rounded(capped(views.stored(views.ml_matrix, spark, sf), ["row_id"], 5000).select("row_id", "y"), "y")


def _scores_sql(tail: str = "") -> str:
    long = " union all ".join(
        f"select '{f}' as feature, cast({f} as double) as x, y from ml_ordered"
        for f in FEATURES
    )
    return f"""
        select feature, round(sum(n / t * ln(n * t / (tx * ty))), 6) as score from (
          select feature, cast(n as double) as n, cast(sum(n) over (partition by feature) as double) as t,
            cast(sum(n) over (partition by feature, bx) as double) as tx,
            cast(sum(n) over (partition by feature, "by") as double) as ty
          from (select feature, bx, "by", count(*) as n from (
            select feature,
              floor((rank() over (partition by feature order by x) - 1) * 10
                    / count(*) over (partition by feature)) as bx,
              floor((rank() over (partition by feature order by y) - 1) * 10
                    / count(*) over (partition by feature)) as "by"
            from ({long})) group by all))
        group by feature {tail}"""


def _scores(spark, sf):
    return mutual_information(views.stored(views.ml_filled, spark, sf), FEATURES, "y")


@query(_scores_sql())
def mi_binned(spark, sf):
    return rounded(_scores(spark, sf), "score")


@query(_scores_sql("order by score desc, feature limit 3"))
def mi_top_k(spark, sf):
    return rounded(top_k(_scores(spark, sf), 3), "score")


_NEAR_FEATURES = ["f_qty", "f_discount", "f_lines"]
_NEAR_ROWS = " union all ".join(
    f"select '{f}' as feature, row_id, cast(floor(({f} - min({f}) over ()) / stddev_pop({f}) over () * 1048576.0) as bigint) as x, "
    "cast(floor((y - min(y) over ()) / stddev_pop(y) over () * 1048576.0) as bigint) as y from ml_filled"
    for f in _NEAR_FEATURES
)


@query(
    f"""select * from (with points as materialized ({_NEAR_ROWS}),
      near as (select a.feature, a.row_id, any_value(a.x) as x, any_value(a.y) as y, min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 3)[3] as r
        from points a join points b on a.feature = b.feature and a.row_id <> b.row_id group by a.feature, a.row_id),
      reach as (select *, greatest(r - 1, 0) as w from near where r is not null),
      counted as (select feature,
          count(*) over (partition by feature order by x range between w preceding and w following) as nx,
          count(*) over (partition by feature order by y range between w preceding and w following) as ny,
          case when r > 0 then 3 else count(*) over (partition by feature, x, y) end as k,
          count(*) over (partition by feature) as n from reach),
      psi as (select i as z, coalesce(sum(1.0 / (i - 1)) over (order by i rows between unbounded preceding and current row), 0) - 0.5772156649015329 as p
        from range(2, (select count(*) + 2 from ml_filled)) t(i) union all select 1, -0.5772156649015329)
      select feature, round(greatest(0, any_value(pn.p) + avg(pk.p - px.p - py.p)), 6) as score
      from counted join psi px on px.z = nx join psi py on py.z = ny join psi pn on pn.z = n join psi pk on pk.z = k group by feature)"""
)
def mi_neighbours(spark, sf):
    """Nearest-neighbour estimate over all rows; the SQL compares every pair."""
    return rounded(neighbour_information(views.stored(views.ml_filled, spark, sf), _NEAR_FEATURES, "y"), "score")


@query(
    """select feature, round((1 - case feature when 'f_qty' then bc * bc when 'f_price' then ac * ac
         else ab * ab end) / (1 - ab * ab - ac * ac - bc * bc + 2 * ab * ac * bc), 6) as vif
       from (select corr(f_qty, f_price) as ab, corr(f_qty, f_lines) as ac, corr(f_price, f_lines) as bc
             from ml_matrix), (values ('f_qty'), ('f_price'), ('f_lines')) t(feature)"""
)
def vif_three_features(spark, sf):
    columns = ["f_qty", "f_price", "f_lines"]
    vifs = variance_inflation(correlation_matrix(views.stored(views.ml_matrix, spark, sf), columns))
    rows = [(c, float(v)) for c, v in zip(columns, vifs)]
    return rounded(spark.createDataFrame(rows, "feature string, vif double"), "vif")


@query()
def vif_prune(spark, sf):
    matrix = views.stored(views.ml_filled, spark, sf)
    kept, dropped = prune_by_vif(correlation_matrix(matrix, FEATURES), FEATURES, 5.0)
    rows = [(c, True, None) for c in kept] + [(c, False, None if isinf(v) else v) for c, v in dropped]
    return rounded(spark.createDataFrame(rows, "feature string, kept boolean, vif double"), "vif")


@query()
def feature_selection(spark, sf):
    """Both stages on the 64 components of the embeddings, with the label as target."""
    vectors = views.table(spark, sf, "embeddings")
    columns = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)]
    matrix = vectors.select("vec_id", F.col("label").cast("double").alias("label"), *columns)
    selector = FeatureSelector(n_mi=20).fit(matrix, ["vec_id"], "label")
    return selector.transform(matrix)


@query("select row_id, place <= ceil(round(0.15 * n, 6)) as is_test from ml_ordered")
def train_test_split(spark, sf):
    train, test = split_train_test(views.stored(views.ml_matrix, spark, sf).select("row_id"), ["row_id"])
    return train.withColumn("is_test", F.lit(False)).unionAll(test.withColumn("is_test", F.lit(True)))


@query(
    """select row_id, cast(case when place <= (n % 5) * (n // 5 + 1) then (place - 1) // (n // 5 + 1)
         else n % 5 + (place - 1 - (n % 5) * (n // 5 + 1)) // (n // 5) end as int) as fold from ml_ordered"""
)
def kfold_assign(spark, sf):
    return kfold(views.stored(views.ml_matrix, spark, sf).select("row_id"), ["row_id"])


_GUESS = "1.3 * f_price + 900.0 * f_lines + 55.0 * f_qty"


@query(
    f"""select round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) as r2,
          round(sqrt(avg((y - p) * (y - p))), 6) as rmse, round(stddev_pop(y), 6) as y_std,
          round(avg(y), 6) as y_mean from (select y, {_GUESS} as p from ml_filled)"""
)
def regression_metrics(spark, sf):
    scored = views.ml_filled(spark, sf).withColumn("prediction", F.expr(_GUESS))
    return rounded(metrics_of(scored, "y", "prediction"), "r2", "rmse", "y_std", "y_mean")


_USED = ["f_price", "f_lines", "f_qty", "f_tax"]
_VARIANTS = " union all ".join(
    f"select '{f}' as feature, rep, y, "
    + _GUESS.replace(f, f"o_{f}")
    + " as p from moved"
    for f in _USED
)


@query(
    f"""select feature, round(avg(base - s), 6) as importance_mean,
          round(stddev_pop(base - s), 6) as importance_std
        from (select feature, rep, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)) as s from (
            with rows as (select *, place - 1 as i, count(*) over () as size from ml_test),
            steps as (select rep, n, (43 + rep) * 104729 % n as b,
                list_filter(range(greatest(1, (43 + rep) * 7919 % n), greatest(1, (43 + rep) * 7919 % n) + 1000), lambda x: gcd(x, n) = 1)[1] as a
              from generate_series(0, 14) g(rep), (select count(*) as n from ml_test)),
            moved as (select s.rep, m.y, {', '.join(f"m.{f}" for f in _USED)}, {', '.join(f"o.{f} as o_{f}" for f in _USED)}
              from rows m cross join steps s join rows o on o.i = (s.a * m.i + s.b) % s.n)
            {_VARIANTS}) group by feature, rep) v,
          (select 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)) as base
           from (select y, {_GUESS} as p from ml_test)) b
        group by feature"""
)
def permutation_importance_linear(spark, sf):
    """Importances of a fixed linear scorer, so that every digit can be compared."""
    _, test = split_train_test(views.ml_filled(spark, sf), ["row_id"])
    scorer = lambda df: df.withColumn("prediction", F.expr(_GUESS))
    found = importances(scorer, test, ["row_id"], _USED, "y")
    return rounded(found, "importance_mean", "importance_std")


def _forest() -> Regression:
    return Regression(RandomForestRegressor, numTrees=10, maxDepth=5, seed=42)


@query()
def rf_predict(spark, sf):
    matrix = views.ml_filled(spark, sf)
    train, test = split_train_test(matrix, ["row_id"])
    return _forest().fit(train, FEATURES, "y").predict(test).select("row_id", "y", "prediction")


@query()
def permutation_importance(spark, sf):
    _, found, _ = _forest().train_test_with_permutation_importance(
        views.ml_filled(spark, sf), ["row_id"], FEATURES, "y"
    )
    return found


@query()
def grid_search_cv(spark, sf):
    ridge = Regression(LinearRegression, maxIter=20)
    grid = {"regParam": [0.0, 1000.0], "elasticNetParam": [0.0, 0.5]}
    return ridge.tune(views.ml_filled(spark, sf), ["row_id"], FEATURES, "y", grid)[1]


_FOLDED = """select row_id, f_price as x, y, cast(case when place <= (n % 5) * (n // 5 + 1) then (place - 1) // (n // 5 + 1)
         else n % 5 + (place - 1 - (n % 5) * (n // 5 + 1)) // (n // 5) end as int) as fold from ml_ordered"""


_FITS = f"""select g.fold, regr_slope(y, x) as a, regr_intercept(y, x) as b
    from ({_FOLDED}) t join generate_series(0, 4) g(fold) on t.fold <> g.fold group by g.fold"""


@query(
    f"""select cast(fold as int) as fold, round(score, 6) as score, round(avg(score) over (), 6) as mean_test_score,
          round(stddev_pop(score) over (), 6) as std_test_score, 1 as rank_test_score from (
            select fold, 1 - sum((y - a * x - b) * (y - a * x - b)) / (var_pop(y) * count(y)) as score
            from ({_FOLDED}) join ({_FITS}) using (fold) group by fold)"""
)
def grid_search_linear(spark, sf):
    """Fold scores of plain least squares on one feature, in closed form in the SQL."""
    ridge = Regression(LinearRegression, maxIter=20, solver="normal")
    results = ridge.tune(views.stored(views.ml_filled, spark, sf), ["row_id"], ["f_price"], "y", {"regParam": [0.0]}, refit=False)[1]
    by_fold = results.select(F.posexplode("fold_scores").alias("fold", "score"), "mean_test_score", "std_test_score", "rank_test_score")
    return rounded(by_fold, "score", "mean_test_score", "std_test_score")


_RIDGE_FOLDS = _FOLDED.replace("f_price as x", "f_price as u, f_lines as v")
_RIDGE_FITS = f"""select fold, penalty, b1, b2, my - b1 * mu - b2 * mv as b0 from (
    select *, ((1 + l) * ruy - ruv * rvy) / ((1 + l) * (1 + l) - ruv * ruv) * sy / su as b1,
      ((1 + l) * rvy - ruv * ruy) / ((1 + l) * (1 + l) - ruv * ruv) * sy / sv as b2 from (
      select g.fold, penalty, penalty / stddev_pop(y) as l, corr(u, v) as ruv, corr(u, y) as ruy, corr(v, y) as rvy,
        avg(u) as mu, avg(v) as mv, avg(y) as my, stddev_pop(u) as su, stddev_pop(v) as sv, stddev_pop(y) as sy
      from ({_RIDGE_FOLDS}) t join generate_series(0, 4) g(fold) on t.fold <> g.fold, (values (0.0), (20000.0)) p(penalty)
      group by g.fold, penalty))"""


@query(
    f"""select param_regParam, cast(fold as int) as fold, round(score, 6) as score, round(mean, 6) as mean_test_score,
          round(std, 6) as std_test_score, cast(dense_rank() over (order by mean desc) as int) as rank_test_score from (
            select *, avg(score) over (partition by penalty) as mean, stddev_pop(score) over (partition by penalty) as std from (
              select cast(cast(penalty as double) as varchar) as param_regParam, penalty, fold,
                1 - sum((y - b0 - b1 * u - b2 * v) * (y - b0 - b1 * u - b2 * v)) / (var_pop(y) * count(y)) as score
              from ({_RIDGE_FOLDS}) join ({_RIDGE_FITS}) using (fold) group by fold, penalty))"""
)
def grid_search_ridge(spark, sf):
    """Two features and two penalties, all fold scores from one pass; normal equations in the SQL."""
    linear = Regression(LinearRegression, solver="normal")
    rows = views.stored(views.ml_filled, spark, sf)
    results = linear.tune(rows, ["row_id"], ["f_price", "f_lines"], "y", {"regParam": [0.0, 20000.0]}, refit=False)[1]
    by_fold = results.select(
        "param_regParam", F.posexplode("fold_scores").alias("fold", "score"), "mean_test_score", "std_test_score", "rank_test_score"
    )
    return rounded(by_fold, "score", "mean_test_score", "std_test_score")


@query(
    """select row_id, round(y, 6) as y, round(a * f_price + b, 4) as prediction from ml_test,
          (select regr_slope(y, f_price) as a, regr_intercept(y, f_price) as b from ml_ordered
           where place > ceil(round(0.15 * n, 6)))"""
)
def linear_predict(spark, sf):
    """Fitted and predicted values of one feature, in closed form in the SQL."""
    train, test = split_train_test(views.stored(views.ml_filled, spark, sf), ["row_id"])
    fitted = Regression(LinearRegression, maxIter=20, solver="normal").fit(train, ["f_price"], "y").predict(test)
    return fitted.select("row_id", F.round("y", 6).alias("y"), F.round("prediction", 4).alias("prediction"))
