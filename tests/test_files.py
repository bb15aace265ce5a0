"""Reading and writing real files, and the whole build from them."""

import json
from datetime import datetime

import pandas as pd
import re

import pytest
from pyspark.sql import functions as F

from panelweave import PanelConfig
from panelweave.operators.labels import last_wins, unknown_labels
from panelweave.plans.blocs import european_panel
from panelweave.plans.dataset import build_dataset, load_places
from panelweave.sinks import dataset_name, write_sorted_csv, write_versioned
from panelweave.sources import cached, scan_covariates, scan_elections, scan_lookup_csv, scan_projected
from panelweave.sources.elections import election_files


def put(path, **columns):
    path.parent.mkdir(parents=True, exist_ok=True)
    pd.DataFrame(columns).to_parquet(path, index=False)


@pytest.fixture
def tree(tmp_path):
    """A small data folder in the layout of the inputs."""
    votes = tmp_path / "elections"
    put(votes / "presidentiel/1995/results.parquet", codecommune=["01001", "01002", "69380"],
        inscrits=[100, 200, 300], C=[0.1, 0.2, 0.3], extra=[1, 2, 3])
    put(votes / "presidentiel/2002/results.parquet", codecommune=["01001", "01003", None],
        inscrits=[110.0, 210.0, 5.0], C=[0.4, None, 0.6])
    put(votes / "legislative/1997/good.parquet", codecommune=["01001"], inscrits=[90], C=[0.5])
    put(votes / "legislative/1997/bad.parquet", codecommune=["01001"], inscrits=[1], C=[0.0])
    put(votes / "referendum/2005/results.parquet", codecommune=["01001"], inscrits=[70], C=[0.7])
    put(tmp_path / "income/incomecommunes.parquet", codecommune=["01001", "01002", "99999", None],
        rev1995=[1.0, 2.0, 3.0, 4.0], rev2000=[10.0, None, 30.0, 40.0], label=["a", "b", "c", "d"])
    put(tmp_path / "agecommunes1999.parquet", codecommune=["01001"], age1999mean=[42], age1999=[40])
    put(tmp_path / "menagescommunes.parquet", codecommune=["01001"], dep=["01"], menages=[7])
    put(tmp_path / "codescommunes.parquet", codecommune=["01001"], ignored1999=[1])
    put(tmp_path / "other.parquet", codecommune=["01001"], ignored1999=[1])
    features = [
        {"properties": {"code": "01001"},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}},
        {"properties": {"code": "75056"},
         "geometry": {"type": "MultiPolygon", "coordinates": [[[[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]]]}},
    ]
    (tmp_path / "communes.geojson").write_text(
        json.dumps({"type": "FeatureCollection", "features": features}, indent=1)
    )
    return tmp_path


def test_scan_projected_checks_unkept_columns(spark, tmp_path):
    put(tmp_path / "t.parquet", a=[1, 2, 3], b=["x", None, "y"], c=[1, 1, 1])
    found = scan_projected(spark, str(tmp_path / "t.parquet"), ["c", "a"], ["b"], F.col("b") != "y")
    assert found.columns == ["c", "a"] and [tuple(r) for r in found.collect()] == [(1, 1)]


def test_scan_elections(spark, tree):
    found = scan_elections(spark, str(tree / "elections"), ["C"], exclude=["bad.parquet"])
    rows = {(r.codecommune, r.election_type, r.annee, r.inscrits, r.pvoteC) for r in found.collect()}
    assert rows == {
        ("01001", "presidentiel", 1995, 100.0, 0.1), ("01002", "presidentiel", 1995, 200.0, 0.2),
        ("01001", "presidentiel", 2002, 110.0, 0.4), ("01003", "presidentiel", 2002, 210.0, None),
        (None, "presidentiel", 2002, 5.0, 0.6),
        ("01001", "legislative", 1997, 90.0, 0.5), ("01001", "referendum", 2005, 70.0, 0.7),
    }
    paths = {(t, y): p for t, y, _, p in election_files(spark, str(tree / "elections"), ["bad.parquet"])}
    assert paths["legislative", 1997][0].endswith("good.parquet")
    assert paths["presidentiel", 1995][0].endswith("/1995")


def test_folders_may_repeat_the_root_name(spark, tmp_path):
    put(tmp_path / "elections/referendum/2005/elections/part.parquet", codecommune=["1"], inscrits=[1], C=[0.5])
    put(tmp_path / "elections/referendum/2005bis/x.parquet", codecommune=["1"], inscrits=[1], C=[0.5])
    put(tmp_path / "elections/readme/x.parquet", codecommune=["1"], inscrits=[1], C=[0.5])
    for root in (f"{tmp_path}/elections/", f"file://{tmp_path}/elections"):
        found = scan_elections(spark, root, ["C"]).select("election_type", "annee", "round")
        assert {tuple(r) for r in found.collect()} == {("referendum", 2005, ""), ("referendum", 2005, "bis")}


def test_a_filter_on_type_drops_whole_scans(spark, tree):
    found = scan_elections(spark, str(tree / "elections"), ["C"]).filter("election_type = 'referendum'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_scan_covariates(spark, tree):
    found = scan_covariates(spark, str(tree)).filter("codecommune = '01001'")
    assert {(r.feature, r.annee, r.value) for r in found.collect()} == {
        ("incomecommunes/rev", 1995, 1.0), ("incomecommunes/rev", 2000, 10.0),
        ("agecommunes1999/agemean", 1999, 42.0), ("agecommunes1999/age", 1999, 40.0),
        ("menagescommunes/menages_", 1975, 7.0),
    }


def test_lookup_csv_last_line_wins(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text('Nuance,Libellé,Tendance\n\nX,"a, b",Centre\n\nY,c,\nX,"d ""e""",\nZ,f,Gauche\n', encoding="utf-8")
    found = scan_lookup_csv(spark, str(path))
    assert {tuple(r) for r in found.collect()} == {("X", None), ("Y", None), ("Z", "Gauche")}
    by_label = scan_lookup_csv(spark, str(path), ["Nuance", "Libellé"])
    assert ("X", "a, b", "Centre") in {tuple(r) for r in by_label.collect()}
    wrong = unknown_labels(by_label, "Tendance", ["Gauche"])
    assert [r["Nuance"] for r in wrong.collect()] == ["X"]


def test_sorted_csv_puts_missing_last(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "z"), ("c", "y, x")], "Nuance string, Tendance string")
    write_sorted_csv(df, str(tmp_path / "out"), "Tendance")
    lines = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()
    assert lines == ["Nuance,Tendance", 'c,"y, x"', "b,z", "a,"]


def test_cache_is_keyed_and_never_overwritten(spark, tmp_path):
    calls = []

    def build(n):
        def run():
            calls.append(n)
            return spark.range(n)
        return run

    folder = str(tmp_path)
    assert cached(spark, folder, "k1", build(3)).count() == 3
    assert cached(spark, folder, "k1", build(5)).count() == 3
    assert cached(spark, folder, "k2", build(5)).count() == 5
    assert cached(spark, folder, "k1", build(7), use_cached=False).count() == 7
    assert cached(spark, folder, "k1", build(9)).count() == 3
    assert calls == [3, 5, 7]


def test_versioned_name_and_layout(spark, tmp_path):
    cfg = PanelConfig("d", ("C", "D"), include_elections=("presidentiel",), min_year=1990, output_dir=str(tmp_path))
    at = datetime(2024, 1, 2, 3, 4, 5)
    assert dataset_name(cfg, at) == "data_C_D_1990_presidentiel_20240102_030405.parquet"
    df = spark.createDataFrame([(0, 1995, 1.0), (1, 2002, 2.0)], "type int, annee int, v double")
    path = write_versioned(df, cfg, at=at)
    back = spark.read.parquet(path)
    assert {(r.type, r.annee, r.v) for r in back.collect()} == {(0, 1995, 1.0), (1, 2002, 2.0)}


def test_config_rejects_unknown_augmentation():
    with pytest.raises(ValueError):
        PanelConfig("d", ("C",), features_aug=("square",))


def config(tree, **changes):
    base = dict(
        data_path=str(tree), vote_variables=("C",), elections_to_exclude=("bad.parquet",),
        features_aug=("raw", "lag", "rank"), geojson_path=str(tree / "communes.geojson"),
        include_elections=("presidentiel", "legislative"), min_year=1996,
        output_dir=str(tree / "out"), cache_dir=str(tree / "cache"),
    )
    return PanelConfig(**{**base, **changes})


def test_build_dataset_from_files(spark, tree):
    built = build_dataset(spark, config(tree))
    assert built.elections == [("legislative", 1997), ("presidentiel", 2002)]
    rows = {(r.codecommune, r.annee): r.asDict() for r in built.rows.collect()}
    assert set(rows) == {("01001", 1997), ("01001", 2002), (None, 2002)}
    one = rows["01001", 2002]
    assert (one["type"], one["inscrits"], one["pvoteC"], one["pvotepreviousC"]) == (0, 110.0, 0.4, 0.1)
    assert (one["centroid_x"], one["centroid_y"]) == (1.0, 1.0)
    assert one["incomecommunes/rev"] == 10.0 and one["incomecommunes/rev_lag"] == 1.0
    assert one["agecommunes1999/age"] == 40.0
    assert not any(c.startswith("menages") for c in one)
    # 1995 backs 1997 up; the covariate row without a commune joins the vote row without one
    assert rows["01001", 1997]["incomecommunes/rev"] == 1.0
    assert rows[None, 2002]["incomecommunes/rev"] == 40.0
    # ranks count the communes of the elections and the row without a code
    assert one["incomecommunes/rev_rank"] == pytest.approx(1 / 2)
    assert {(r.election_type, r.annee, r.column, r.dropped) for r in built.dropped.collect()} == {
        ("legislative", 1997, "pvoteC", 0), ("presidentiel", 2002, "pvoteC", 1)
    }
    filled = {r.filled: r.source for r in built.backfill.filter("target = 1997").collect()}
    assert filled["incomecommunes/rev1997"] == "incomecommunes/rev1995"
    assert {r.election_type for r in built.backfill.filter("target = 1997").collect()} == {"legislative"}


def test_build_one_election_with_quality_filter(spark, tree):
    cfg = config(tree, one_election=True, target_year=2002, target_type="presidentiel", quality_filter=True,
                 encoding_type="average_vote_C", output_dir=None, features_aug=("raw",))
    built = build_dataset(spark, cfg)
    rows = built.rows
    assert "pvotepreviouspreviousC" in built.removed_columns
    assert {r.codecommune for r in rows.collect()} == {"01001", None}
    # mean of the yearly means 0.15 and 0.5
    assert rows.first()["type"] == pytest.approx(0.325)


def test_covariates_of_unused_years_are_not_read(spark, tree):
    cfg = config(tree, features_aug=("raw",), output_dir=None)
    plan = build_dataset(spark, cfg).rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*annee#\d+ IN \(1995,2000", plan.replace("1999,", ""))


def test_missing_geojson_is_skipped(spark, tree):
    assert load_places(spark, str(tree / "none.geojson")) is None
    places = load_places(spark, str(tree / "communes.geojson"))
    assert places.count() == 2 + 20


def test_european_panel_from_files(spark, tmp_path):
    put(
        tmp_path / "ballots.parquet",
        **{
            "id_election": ["2019_euro_t1"] * 4 + ["2017_pres_t1", None],
            "id_brut_miom": ["x"] * 6,
            "Code du département": ["01", "01", "01", "02", "01", "01"],
            "Code de la commune": ["001", "001", "002", "001", "001", "001"],
            "Nuance": ["REM", "LENS", "LXX", "DIV", "REM", "REM"],
            "Voix": [30, 10, 5, 7, 99, 99],
            **{c: ["x"] * 6 for c in ("Code du b.vote", "Libellé Abrégé Liste", "Libellé Etendu Liste",
                                      "Nom Tête de Liste", "Nom", "Prénom", "Binôme", "Liste")},
        },
    )
    put(
        tmp_path / "general.parquet",
        **{
            "id_election": ["2019_euro_t1", "2019_euro_t1", "2017_pres_t1"],
            "Code du département": ["01", "01", "01"], "Code de la commune": ["001", "001", "001"],
            "Inscrits": [60, 20, 500],
        },
    )
    (tmp_path / "codes.csv").write_text("Nuance,Libellé,Tendance\nREM,x,Centre\nDIV,y,\nLENS,z,\n", encoding="utf-8")
    (tmp_path / "hand.csv").write_text("Nuance,Libellé,Tendance\nREM,x,Droite\n\nLENS,z,Centre-droit\n", encoding="utf-8")
    panel = european_panel(
        spark, str(tmp_path / "ballots.parquet"), str(tmp_path / "general.parquet"),
        [str(tmp_path / "codes.csv"), str(tmp_path / "hand.csv")],
    )
    rows = [r.asDict() for r in panel.collect()]
    assert rows == [{
        "codecommune": "01001", "annee": 2019, "pvotepvoteC": 0.75, "pvotepvoteCD": 0.25,
        "pvotepvoteCG": 0.0, "pvotepvoteD": 0.0, "pvotepvoteG": 0.0, "pvoteppar": 0.5, "inscrits": 80, "type": 3,
    }]


def test_last_wins_ignores_missing_keys(spark):
    df = spark.createDataFrame([(1, None, "A")], "p int, k string, v string")
    assert last_wins(df, "k", "v", "p").isEmpty()


def test_a_build_without_matching_years_keeps_its_rows(spark, tree):
    cfg = config(tree, include_elections=("referendum",), min_year=2005, max_past_years=0, output_dir=None)
    built = build_dataset(spark, cfg)
    assert built.elections == [("referendum", 2005)]
    assert [(r.codecommune, r.pvoteC) for r in built.rows.collect()] == [("01001", 0.7)]
    assert built.backfill.isEmpty()
    none = build_dataset(spark, config(tree, min_year=2100, output_dir=None))
    assert none.elections == [] and none.rows.isEmpty()
