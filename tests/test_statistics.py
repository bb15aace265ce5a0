"""Nearest neighbours, sums of products, consecutive numbers, split documents."""

import json
import random

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from panelweave import storage
from panelweave.functions.geometry import geometry_polygons
from panelweave.operators import neighbours
from panelweave.operators.evaluation import Regression
from panelweave.operators.moments import products_by_fold, ridge
from panelweave.operators.neighbours import digamma, neighbour_information, radii, whole_points
from panelweave.operators.ordering import number_in_order
from panelweave.sources import scan_geojson


def harmonic(z):
    return sum(1.0 / i for i in range(1, z)) - 0.5772156649015329


def plain_information(xs, ys, k):
    """The estimate by comparing every two rows."""
    rows = [(x, y) for x, y in zip(xs, ys) if None not in (x, y) and x == x and y == y]
    whole = []
    for v, column in zip((np.array(c, float) for c in zip(*rows)), (xs, ys)):
        every = np.array([c for c in column if c is not None and c == c])  # a column's scale is its own
        whole.append(np.floor((v - every.min()) / every.std() * 2**20).astype(np.int64) if every.std() else np.zeros(len(v), np.int64))
    apart = [np.abs(w[:, None] - w) for w in whole]
    both = np.maximum(*apart).astype(float)
    np.fill_diagonal(both, np.inf)
    radius = np.sort(both, axis=1)[:, k - 1]
    reach = np.maximum(radius - 1, 0)
    psi = [harmonic(int(n)) for a in apart for n in (a <= reach[:, None]).sum(axis=1)]
    near = [harmonic(k if r > 0 else int((row == 0).sum()) + 1) for r, row in zip(radius, both)]
    return max(0.0, harmonic(len(rows)) + (sum(near) - sum(psi)) / len(rows))


def matrix(spark, seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.gauss(1000, 3)
        rows.append((i, y, y + rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randrange(3)), 7.0, 0.0 if i % 3 else rng.random() ** 9 * 1e6, None if i % 5 else y * 2))
    rows += [(n + i, 1000.0, 5.0, 5.0, 1.0, 7.0, 0.0, 2.0) for i in range(n // 2)]  # a third of all rows are equal
    rows += [(2 * n, None, 1.0, 1.0, 1.0, 7.0, 1.0, 1.0), (2 * n + 1, 1.0, float("nan"), 1.0, 1.0, 7.0, 1.0, None)]
    return spark.createDataFrame(rows, "i long, y double, near double, `far.away` double, few double, same double, skewed double, gaps double")


FEATURES = ["near", "far.away", "few", "same", "skewed", "gaps"]


@pytest.mark.parametrize("cell_points, k", [(16, 3), (1000, 5)])
def test_neighbour_information_equals_all_pairs(spark, cell_points, k):
    df = matrix(spark, 1, 300).cache()
    found = {r["feature"]: r["score"] for r in neighbour_information(df, FEATURES, "y", k, cell_points=cell_points, rows_per_task=200).collect()}
    rows = df.collect()
    for f in FEATURES:
        assert found[f] == pytest.approx(plain_information([r[f] for r in rows], [r["y"] for r in rows], k), abs=1e-9), f
    assert found["near"] > found["far.away"]


def test_visitors_are_split_and_few_rows_score_zero(spark):
    df = matrix(spark, 2, 120)
    points = whole_points(df, ["near", "skewed"], "y").cache()
    small = {tuple(r) for r in radii(points, 3, cell_points=10, visitors=2).collect()}
    assert small == {tuple(r) for r in radii(points, 3, cell_points=5000).collect()} and len(small) == points.count()
    few = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (None, 1.0)], "x double, y double")
    assert neighbour_information(few, ["x"], "y").first()["score"] == 0.0
    assert neighbour_information(few.filter("x > 9"), ["x"], "y").first()["score"] == 0.0


def test_a_point_meets_blocks_of_boxes(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(neighbours, "stage", lambda df, name: seen.setdefault(name, storage.stage(df, name)))
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(3000, 2))], "x double, y double").repartition(4)
    near = radii(whole_points(df, ["x"], "y"), cell_points=4)
    plain = {(r.x, r.y): r.radius for r in near.collect()}
    points = np.array(list(plain))
    apart = np.abs(points[:, None] - points).max(axis=2)
    assert [plain[tuple(p)] for p in points] == np.sort(apart, axis=1)[:, 3].tolist()
    strips, longest = seen["strip_boxes"].count(), seen["strip_boxes"].agg(F.max(F.size("_cells"))).first()[0]
    assert strips > 20 and longest <= strips / 3


def test_digamma(spark):
    rows = spark.range(1, 400).select("id", digamma(F.col("id")).alias("d")).collect()
    assert max(abs(r["d"] - harmonic(r["id"])) for r in rows) < 1e-9


@pytest.mark.parametrize("settings", [{}, {"standardization": False}])
def test_scores_from_products_equal_fits(spark, settings):
    rng = random.Random(4)
    rows = [(i, a := rng.gauss(50, 2), b := rng.random(), 3.0, 2 * a - 40 * b + rng.gauss(0, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, y double").cache()
    grid = {"regParam": [0.0, 0.5, 30.0]}
    linear = Regression(LinearRegression, solver="normal", **settings)
    for scoring in ("r2", "neg_root_mean_squared_error", "neg_mean_squared_error"):
        assert linear._from_products([{}], scoring)
        quick = linear.tune(df, ["i"], ["a", "b", "c"], "y", grid, scoring=scoring, refit=False, cv_splits=3)[1]
        slow = Regression(LinearRegression, solver="normal", **settings)
        slow._from_products = lambda points, scoring: False
        fitted = slow.tune(df, ["i"], ["a", "b", "c"], "y", grid, scoring=scoring, refit=False, cv_splits=3)[1]
        a, b = ({r["param_regParam"]: r["fold_scores"] for r in t.collect()} for t in (quick, fitted))
        for point in a:
            assert a[point] == pytest.approx(b[point], rel=1e-4, abs=1e-9), (scoring, point)  # fits fall back to steps where a feature is constant
    for other in ({"elasticNetParam": 0.5}, {"fitIntercept": False}, {"solver": "l-bfgs"}, {"weightCol": "i"}):
        assert not Regression(LinearRegression)._from_products([other], "r2")


def test_an_elastic_net_is_searched_on_a_few_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal([1e4, 0, 3], [1, 50, 2], (400, 3))
    y = x @ [2.0, 0.1, 0.0] + rng.normal(size=400)
    df = spark.createDataFrame([(i, *map(float, r), 7.0, float(v)) for i, (r, v) in enumerate(zip(x, y))], "i int, a double, b double, c double, same double, y double")
    columns, grid = ["a", "b", "c", "same"], {"regParam": [0.0, 0.3], "elasticNetParam": [0.0, 0.5, 1.0]}
    slow = Regression(LinearRegression)
    slow._plain_linear = lambda points, scoring: False
    fitted = slow.tune(df, ["i"], columns, "y", grid, refit=False, cv_splits=3)[1]
    monkeypatch.setattr(Regression, "_scores_by_fitting", None)  # no fit on the rows
    quick = Regression(LinearRegression).tune(df, ["i"], columns, "y", grid, refit=False, cv_splits=3)[1]
    key = lambda r: (r.param_regParam, r.param_elasticNetParam)
    for a, b in zip(sorted(quick.collect(), key=key), sorted(fitted.collect(), key=key)):
        assert key(a) == key(b) and a.fold_scores == pytest.approx(b.fold_scores, abs=1e-5)


def test_products_need_one_pass_and_few_numbers(spark):
    df = spark.range(1000).selectExpr("id % 4 as fold", "cast(id as double) x", "cast(3 * id + 1e9 as double) y")
    products = products_by_fold(df, ["x"], "y", "fold")
    assert sorted(products) == [0, 1, 2, 3] and all(p.shape == (3, 3) for p in products.values())
    weights = ridge(sum(products.values()), 0.0)
    assert weights[1] == pytest.approx(3.0) and sum(p[0, 0] for p in products.values()) == 1000


def test_numbers_follow_the_order_over_slices(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, "a", "b", "c"]), i, rng.choice([None, 1.5, 2.5])) for i in range(500)]
    df = spark.createDataFrame(rows, "`k.x` string, i long, v double").repartition(7)
    numbered = number_in_order(df, ["k.x", "v", "i"], "no", rows_per_slice=40)
    assert numbered.columns == ["k.x", "i", "v", "no"]
    got = [(r["k.x"], r["v"], r["i"]) for r in sorted(numbered.collect(), key=lambda r: r["no"])]
    assert got == sorted(got, key=lambda r: ((r[0] is not None, r[0] or ""), (r[1] is not None, r[1] or 0), r[2]))
    assert [r["no"] for r in sorted(numbered.collect(), key=lambda r: r["no"])] == list(range(1, 501))
    assert number_in_order(df.filter("i < 0"), ["i"], "no").count() == 0


def feature(i, rng):
    ring = [[rng.random() * 9, rng.random()] for _ in range(4)]
    odd = ['}', '{"', '\\"}', "[", '"features":[{', "é}", "a\nb", "\\", "\\\\"]
    shape = {"type": "Polygon", "coordinates": [ring + ring[:1]]} if i % 4 else {"type": "MultiPolygon", "coordinates": [[ring + ring[:1]], [ring + ring[:1]]]}
    out = {"type": "Feature", "geometry": shape, "properties": {"code": f"{i:05d}", "name": rng.choice(odd) * rng.randrange(3), "more": {"features": [{"a": {}}, rng.choice(odd)]}}}
    if i % 11 == 0:
        out["geometry"] = None
    if i % 13 == 0:
        out = {"id": "}", "properties": None, "type": "Feature", "geometry": shape}
    return out


@pytest.mark.parametrize("indent", [None, 1])
def test_one_document_is_read_by_many_tasks(spark, tmp_path, indent):
    rng = random.Random(9)
    features = [feature(i, rng) for i in range(150)]
    whole = {"type": "FeatureCollection", "name": 'x "features":[ }', "crs": {"type": "name", "properties": {"name": "}"}}, "bbox": [1, 2], "features": features, "tail": {"a": [1]}}
    files = {"a": whole, "b": {"features": [], "type": "FeatureCollection"}, "c": {"features": features[:3]}}
    for name, document in files.items():
        (tmp_path / f"{name}.geojson").write_text(json.dumps(document, indent=indent, ensure_ascii=name == "a"))
    schema = "features array<struct<geometry struct<type string, coordinates string>, properties struct<code string>>>"
    plain = spark.read.schema(schema).option("multiLine", True).json(str(tmp_path)).select(F.col("_metadata.file_path").alias("file"), F.posexplode("features").alias("index", "f"))
    plain = plain.select(F.struct("file", F.col("index").cast("long")).alias("position"), "f.properties.code", geometry_polygons(F.col("f.geometry.type"), F.col("f.geometry.coordinates")))
    want = sorted(map(str, plain.collect()))
    assert len(want) == 153
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = spark.read.option("lineSep", "}").text(str(tmp_path / "a.geojson"))
        assert read.rdd.getNumPartitions() > 10
        got = scan_geojson(spark, str(tmp_path)).withColumnRenamed("codecommune", "code")
        assert sorted(str((tuple(r[0]), *r[1:])) for r in got.collect()) == sorted(str((tuple(r[0]), *r[1:])) for r in plain.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
