"""Votes + covariates -> one modelling table."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.config import PanelConfig
from panelweave.fixed_values import MAX_PAST_YEARS, TYPE_CODES, UNKNOWN_TYPE_CODE
from panelweave.operators.aggregates import label_values, mean_of_means, widen
from panelweave.operators.asof import asof_backfill, backfill_map, resolve_years
from panelweave.operators.augment import augmented_catalog, variants_long
from panelweave.operators.columns import drop_sparse, dropna_with_counts, quoted
from panelweave.operators.incremental import refreshed_augmentation
from panelweave.operators.joins import semi_keep_null
from panelweave.operators.packed import dictionary, pack
from panelweave.operators.periods import election_history, with_previous_elections
from panelweave.operators.places import add_coordinates, with_unlisted_districts
from panelweave.sinks import write_versioned
from panelweave.sources.cache import refreshed
from panelweave.sources.covariates import covariate_versions, scan_covariates
from panelweave.sources.elections import scan_elections
from panelweave.sources.geojson import scan_centroids
from panelweave.sources.listing import dataset_versions
from panelweave.storage import new_path, shared_folder, stage

# --- fixed value: the election whose rows without a commune code are dropped --
ELECTION_WITH_UNCODED_ROWS = ("referendum", 1946)

_NO_CODE = "\x00"


def type_code(election_type: Column) -> Column:
    """Numeric code of an election type; -1 for a type without one."""
    coded = reduce(
        lambda chain, item: F.when(election_type == item[0], item[1]).otherwise(chain),
        TYPE_CODES.items(),
        F.lit(UNKNOWN_TYPE_CODE),
    )
    return coded


def encode_type(df: DataFrame, encoding: str, votes: DataFrame) -> DataFrame:
    """Add ``type``: a code, or with ``average_vote_{var}`` the type's mean share."""
    if not encoding.startswith("average_vote_"):
        return df.withColumn("type", type_code(F.col("election_type")))
    column = "pvote" + encoding.removeprefix("average_vote_")
    means = mean_of_means(votes, [column]).collect()  # one row per election type
    known = {r["election_type"]: r["mean"] for r in means}
    chain = F.lit(None).cast("double")
    for name in TYPE_CODES:
        if known.get(name) is not None:
            chain = F.when(F.col("election_type") == name, F.lit(known[name])).otherwise(chain)
    return df.withColumn(
        "type",
        F.when(F.col("election_type").isin(*TYPE_CODES), chain).otherwise(
            F.lit(float(UNKNOWN_TYPE_CODE))
        ),
    )


def _coded(df: DataFrame) -> DataFrame:
    """Write a missing commune code out, so that a plain equality join matches it.

    A null-safe join would hash on derived keys and exchange the wide side again.
    """
    return df.withColumn("codecommune", F.coalesce("codecommune", F.lit(_NO_CODE)))


def _uncoded(df: DataFrame) -> DataFrame:
    return df.withColumn("codecommune", F.nullif(F.col("codecommune"), F.lit(_NO_CODE)))


@dataclass(frozen=True)
class Dataset:
    """The table and how it came about: elections included as (type, year),
    years that stood in for others and rows dropped per missing share, both per
    election, columns removed as too sparse, and the dictionary of packed rows."""

    rows: DataFrame
    elections: list[tuple[str, int]]
    backfill: DataFrame
    dropped: DataFrame
    removed_columns: tuple[str, ...] = ()
    labels: DataFrame | None = None  # of packed rows


def assemble(
    votes: DataFrame,
    features: DataFrame,
    vote_columns: list[str],
    selected: Column,
    *,
    places: DataFrame | None = None,
    every_place: bool = False,
    encoding: str = "no",
    max_past: int = MAX_PAST_YEARS,
    catalog: DataFrame | None = None,
    packed: bool = False,
) -> Dataset:
    """One row per commune and selected election.

    ``votes``: (codecommune, election_type, annee, inscrits, pvote...), unique
    on the first three.  ``features``: (codecommune, feature, annee, value),
    likewise; a repeated key is an error.  ``selected`` is a condition on type
    and year.  Every election is served by the same plan: features are re-dated
    to each target year they stand in for, widened on (commune, year), and
    joined to the votes on the partitioning they then have.  ``catalog`` lists
    the (feature, annee) that ``features`` has; without it they are looked up.
    ``every_place`` repeats a row for each listing of its code in ``places``.
    ``packed`` puts the features in one column ``cells``, with ``labels`` for
    their names, where there may be more of them than a table has columns.
    """
    keys = ["codecommune", "election_type", "annee"]
    legacy_type, legacy_year = ELECTION_WITH_UNCODED_ROWS
    uncoded = (
        F.col("codecommune").isNull()
        & (F.col("election_type") == legacy_type)
        & (F.col("annee") == legacy_year)
    )
    # without a code, rows of one election cannot be told apart: they go first
    coded = votes.filter(~uncoded)
    known = election_history(coded)
    history = with_previous_elections(coded, vote_columns, known)
    candidates = history.filter(selected)
    target, dropped = dropna_with_counts(candidates, vote_columns, ["election_type", "annee"])
    elections = sorted((r["election_type"], r["annee"]) for r in known.filter(selected).collect())
    spark = votes.sparkSession
    years = spark.createDataFrame([(y,) for y in sorted({y for _, y in elections})], "target int")
    if catalog is None:
        catalog = features.select("feature", "annee").distinct()
    resolved = resolve_years(catalog, years, max_past)
    redated = _coded(asof_backfill(features, resolved))
    labels = dictionary(resolved, "feature") if packed else None
    if labels is None:
        wide = widen(redated, ["codecommune", "annee"], "feature", "value", label_values(resolved, "feature"))
    else:
        wide = pack(redated, ["codecommune", "annee"], "feature", "value", labels).rows
    rows = _uncoded(_coded(target).join(wide, ["codecommune", "annee"], "left"))
    if places is not None:
        rows = add_coordinates(rows, places, every_place)
    rows = encode_type(rows, encoding, votes)
    feature_names = [c for c in wide.columns if c not in ("codecommune", "annee")]
    extra = ["centroid_x", "centroid_y"] if places is not None else []
    measures = [c for c in target.columns if c not in keys]
    ordered = ["codecommune", "annee", "type", *measures, *extra, *feature_names]
    return Dataset(
        rows=rows.select(*[quoted(c) for c in ordered]),
        elections=elections,
        backfill=backfill_map(resolved).join(
            known.filter(selected).select("election_type", F.col("annee").alias("target")), "target"
        ),
        dropped=dropped,
        labels=labels,
    )


def dataset_for_election(
    votes: DataFrame, features: DataFrame, vote_columns: list[str], year: int, election_type: str, **options
) -> Dataset:
    one = (F.col("annee") == year) & (F.col("election_type") == election_type)
    return assemble(votes, features, vote_columns, one, **options)


def global_dataset(
    votes: DataFrame,
    features: DataFrame,
    vote_columns: list[str],
    include: list[str],
    min_year: int,
    **options,
) -> Dataset:
    several = F.col("election_type").isin(*include) & (F.col("annee") >= min_year)
    return assemble(votes, features, vote_columns, several, **options)


def load_places(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Centroids with city districts, or nothing when there is no file."""
    if not path:
        return None
    try:
        return with_unlisted_districts(stage(scan_centroids(spark, path), "centroids"))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def build_dataset(spark: SparkSession, cfg: PanelConfig) -> Dataset:
    """Load, augment, assemble, filter and save, in that order."""
    root = cfg.data_path.rstrip("/")
    votes = scan_elections(
        spark, f"{root}/elections", cfg.vote_variables, cfg.elections_to_exclude
    )
    vote_columns = [f"pvote{v}" for v in cfg.vote_variables]

    def covariates(files: list[str]) -> DataFrame:
        return semi_keep_null(scan_covariates(spark, root, only=files, source="_input"), votes, "codecommune")

    folder = cfg.cache_dir or f"{shared_folder(spark)}/covariates"
    # the covariates kept depend on the communes of the elections
    ballots = sorted(tuple(r) for r in dataset_versions(spark, f"{root}/elections").select("dataset", "version").collect())
    key = f"{cfg.covariate_key()}-{hashlib.md5(repr(ballots).encode()).hexdigest()[:12]}"
    found = refreshed(
        spark, folder, key, covariate_versions(spark, root), covariates, ("feature", "annee"), "value", cfg.use_cached, ("annee",)
    )
    features, catalog = found.rows, found.catalog
    if list(cfg.features_aug) != ["raw"]:
        # kept beside the covariates: what a changed file does not touch is not computed again
        kept = folder if cfg.use_cached else new_path(spark, "augmented")
        stored = refreshed_augmentation(spark, kept, f"{key}-augmented", features, cfg.features_aug)
        features, catalog = variants_long(stored.rows, cfg.features_aug), augmented_catalog(catalog, cfg.features_aug)
    options = {
        "places": load_places(spark, cfg.geojson_path),
        "every_place": cfg.every_place,
        "encoding": cfg.encoding_type,
        "max_past": cfg.max_past_years,
        "catalog": catalog,
    }
    if cfg.one_election:
        built = dataset_for_election(
            votes, features, vote_columns, cfg.target_year, cfg.target_type, **options
        )
    else:
        built = global_dataset(
            votes, features, vote_columns, list(cfg.include_elections), cfg.min_year, **options
        )
    rows, removed = built.rows, []
    if cfg.quality_filter:
        # the filter counts before it selects: assemble once, read twice
        rows, removed = drop_sparse(stage(rows, "assembled"))
    if cfg.output_dir:
        path = write_versioned(rows, cfg)
        rows = spark.read.parquet(path).select(*[quoted(c) for c in rows.columns])
    return Dataset(rows, built.elections, built.backfill, built.dropped, tuple(removed))
