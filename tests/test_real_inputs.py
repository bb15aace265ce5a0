"""Files and rows as they really come: repeats, gaps, texts, NaN and broken writes."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.operators.columns import drop_sparse, missing_counts, missing_profile
from panelweave.operators.distribution import impute_medians
from panelweave.operators.evaluation import permutation_step
from panelweave.operators.places import add_coordinates, with_unlisted_districts
from panelweave.operators.ordering import number_in_order
from panelweave.operators.sampling import kfold, row_token, sample_capped, split_train_test
from panelweave.operators.selection import FeatureSelector, mutual_information
from panelweave.plans.dataset import global_dataset
from panelweave.sources import cached, scan_covariates, scan_elections, scan_lookup_csv


def put(path, **columns):
    path.parent.mkdir(parents=True, exist_ok=True)
    pd.DataFrame(columns).to_parquet(path, index=False)


def test_covariate_files_of_one_name_are_all_read(spark, tmp_path):
    put(tmp_path / "a/agecommunes.parquet", codecommune=["01001"], pop1999=[5.0])
    put(tmp_path / "b/agecommunes.parquet", codecommune=["01001"], old1999=[7.0])
    found = {(r.feature, r.annee, r.value) for r in scan_covariates(spark, str(tmp_path)).collect()}
    assert found == {("agecommunes/pop", 1999, 5.0), ("agecommunes/old", 1999, 7.0)}


def test_text_covariates_are_named_kept_or_dropped(spark, tmp_path):
    put(tmp_path / "zonecommunes.parquet", codecommune=["01001"], kind1999=["rural"], pop1999=[5.0])
    with pytest.raises(ValueError, match="zonecommunes/kind1999"):
        scan_covariates(spark, str(tmp_path))
    kept = {(r.feature, r.value, r.text) for r in scan_covariates(spark, str(tmp_path), text="keep").collect()}
    assert kept == {("zonecommunes/kind", None, "rural"), ("zonecommunes/pop", 5.0, None)}
    assert [r.feature for r in scan_covariates(spark, str(tmp_path), text="drop").collect()] == ["zonecommunes/pop"]


def test_election_folders_with_suffixes_and_strays(spark, tmp_path):
    put(tmp_path / "presidentiel/2017_t1/x.parquet", codecommune=["1"], inscrits=[1], C=[0.5])
    put(tmp_path / "presidentiel/2017_t2/x.parquet", codecommune=["1"], inscrits=[1], C=[0.5])
    put(tmp_path / "presidentiel/stray.parquet", codecommune=["1"], inscrits=[1], C=[0.5])
    with pytest.warns(UserWarning, match="stray.parquet"):
        rows = scan_elections(spark, str(tmp_path), ["C"]).collect()
    assert sorted((r.annee, r.round) for r in rows) == [(2017, "t1"), (2017, "t2")]
    with pytest.raises(ValueError, match="stray.parquet"):
        scan_elections(spark, str(tmp_path), ["C"], strict=True)
    assert scan_elections(spark, str(tmp_path), ["C"], exclude=["stray.parquet"], strict=True).count() == 2


def test_cache_after_a_broken_write(spark, tmp_path):
    build = lambda: spark.range(10)
    (tmp_path / "k.parquet").mkdir()
    assert cached(spark, str(tmp_path), "k", build).count() == 10
    spark.range(3).write.parquet(str(tmp_path / "half.parquet"))  # no marker behind it
    assert cached(spark, str(tmp_path), "half", build).count() == 10
    assert cached(spark, str(tmp_path), "half", lambda: spark.range(99)).count() == 10


def test_last_line_wins_over_several_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Nuance,Tendance\nX,first\n")
    (tmp_path / "b.csv").write_text("Nuance,Tendance\n" + "".join(f"P{i},p\n" for i in range(500)) + "X,last\n")
    found = {r.Nuance: r.Tendance for r in scan_lookup_csv(spark, str(tmp_path)).collect()}
    assert found["X"] == "last"


def test_every_line_of_a_lookup_on_demand(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Nuance,Libellé,Tendance\nX,"a, b",Centre\n\nX,c,\n,d,Gauche\nX,e,Centre\n', encoding="utf-8")
    found = scan_lookup_csv(spark, str(tmp_path), every=True).collect()
    assert sorted((r.Nuance, r.Tendance or "") for r in found) == [("X", ""), ("X", "Centre"), ("X", "Centre")]


def test_places_listed_twice_and_without_centroid(spark):
    places = spark.createDataFrame(
        [(0, "01001", None, None), (1, "01002", 1.0, 1.0), (2, "01003", 3.0, 3.0), (3, "01003", 9.0, 9.0), (4, "02001", None, None)],
        "position int, codecommune string, centroid_x double, centroid_y double",
    )
    rows = spark.createDataFrame([("01001",), ("01003",), ("01999",), ("02001",), (None,)], "codecommune string")
    found = {r.codecommune: r.centroid_x for r in add_coordinates(rows, places).collect()}
    assert found == {"01001": 1.0, "01003": 3.0, "01999": 1.0, "02001": None, None: None}
    assert add_coordinates(rows, places).count() == 5


def test_every_listing_of_a_place_on_demand(spark):
    places = spark.createDataFrame(
        [(1, "01003", 3.0, 3.0), (1, "01003", 9.0, 9.0), (2, "01003", 5.0, None)], "position int, codecommune string, centroid_x double, centroid_y double"
    )
    rows = spark.createDataFrame([("01003", 1), ("01003", 2), ("01999", 3), ("02001", 4)], "codecommune string, n int")
    found = sorted((r.n, r.centroid_x) for r in add_coordinates(rows, places, every=True).collect() if r.centroid_x)
    assert found == [(1, 3.0), (1, 9.0), (2, 3.0), (2, 9.0), (3, 3.0)]
    assert add_coordinates(rows, places, every=True).count() == 6


def test_districts_listed_themselves_keep_their_centroids(spark):
    places = spark.createDataFrame(
        [(0, "69001", 1.0, 1.0), (1, "69123", 2.0, 2.0), (2, "69381", 3.0, 3.0), (3, "75056", 4.0, 4.0), (4, "75101", None, None)],
        "position int, codecommune string, centroid_x double, centroid_y double",
    )
    rows = spark.createDataFrame([("69123",), ("69381",), ("69382",), ("75101",), ("75120",)], "codecommune string")
    found = {r.codecommune: r.centroid_x for r in add_coordinates(rows, with_unlisted_districts(places)).collect()}
    assert found == {"69123": 2.0, "69381": 3.0, "69382": 1.0, "75101": 4.0, "75120": 4.0}


def test_rows_without_code_do_not_stop_the_build(spark):
    votes = spark.createDataFrame(
        [(None, "referendum", 1946, 1.0, 0.1), (None, "referendum", 1946, 2.0, 0.2), ("01001", "referendum", 1946, 3.0, 0.3), ("01001", "referendum", 1958, 3.0, 0.4)],
        "codecommune string, election_type string, annee int, inscrits double, pvoteC double",
    )
    features = spark.createDataFrame([("01001", "f/x", 1946, 1.0)], "codecommune string, feature string, annee int, value double")
    built = global_dataset(votes, features, ["pvoteC"], ["referendum"], 1900)
    assert sorted((r.codecommune, r.annee) for r in built.rows.collect()) == [("01001", 1946), ("01001", 1958)]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 4.0), (4, float("nan"))], "id int, x double")
    assert missing_counts(df) == (4, {"id": 0, "x": 3})
    assert {r.column: r.missing for r in missing_profile(df).collect()} == {"id": 0, "x": 3}
    assert drop_sparse(df)[1] == ["x"]
    assert [r.x for r in impute_medians(df, ["x"]).orderBy("id").collect()] == [4.0] * 4


KEYS = [("a", None), (None, "a"), ("a|b", "c"), ("a", "b|c"), ("\\N", "x"), (None, "x")]


def test_sizes_are_exact_with_odd_keys(spark):
    df = spark.createDataFrame(KEYS, "k string, l string")
    assert df.select(row_token(["k", "l"])).distinct().count() == len(KEYS)
    for n in range(1, 6):
        assert sample_capped(df, ["k", "l"], n).count() == n
    train, test = split_train_test(df, ["k", "l"], 0.5)
    assert (train.count(), test.count()) == (3, 3)
    assert sorted(r["count"] for r in kfold(df, ["k", "l"], 3).groupBy("fold").count().collect()) == [2, 2, 2]


def test_rows_are_numbered_in_order(spark):
    df = spark.range(500).select("id", F.md5(F.col("id").cast("string")).alias("t"))
    rows = number_in_order(df, ["t"], "i", start=0, rows_per_slice=10).collect()
    assert [r.i for r in sorted(rows, key=lambda r: r.t)] == list(range(500))


@pytest.mark.parametrize("rows", [1, 2, 12, 97, 1000, 100_000])
def test_steps_are_permutations(rows):
    for repeat in range(15):
        a, b = permutation_step(rows, repeat)
        assert len({(a * i + b) % rows for i in range(rows)}) == rows


@pytest.mark.parametrize("rows_per_task", [1_000_000, 50])
def test_mutual_information_is_that_of_ranked_bins(spark, rows_per_task):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=700), 1)
    pdf = pd.DataFrame({"x": x, "z": rng.integers(0, 3, 700).astype(float), "y": x + rng.normal(size=700)})
    binned = {c: np.floor((pdf[c].rank(method="min") - 1) * 10 / len(pdf)) for c in pdf}
    want = {}
    for c in ("x", "z"):
        cells = pd.crosstab(binned[c], binned["y"]).to_numpy() / len(pdf)
        each = cells.sum(1, keepdims=True) * cells.sum(0, keepdims=True)
        want[c] = (cells[cells > 0] * np.log(cells[cells > 0] / each[cells > 0])).sum()
    got = {r.feature: r.score for r in mutual_information(spark.createDataFrame(pdf), ["x", "z"], "y", 10, rows_per_task).collect()}
    assert got == pytest.approx(want)


def test_selection_reads_all_rows_unless_told(spark):
    df = spark.range(3000).selectExpr("id", "cast(id as double) as a", "cast(id % 7 as double) as b", "cast(id * 2 as double) as y")
    assert FeatureSelector(n_mi=2).fit(df, ["id"], "y").selected_features == ["a", "b"]
    assert FeatureSelector(n_mi=1).fit(df, ["id"], "y", max_rows=100).selected_features == ["a"]
