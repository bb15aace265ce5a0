"""Election tables whose type and year are the names of their folders."""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.fixed_values import REMOVED_COMMUNES
from panelweave.functions.numbers import nan_to_null
from panelweave.functions.predicates import not_in
from panelweave.operators.columns import quoted
from panelweave.sources.listing import parquet_datasets

# {type}/{year}/..., each folder optionally written as key=value
_FOLDERS = r"^(?:[^/=]+=)?([^/]+)/(?:[^/=]+=)?(\d{4})[_-]?([^/]*)(?:/.*)?$"


def election_files(
    spark: SparkSession, root: str, exclude: Iterable[str] = (), strict: bool = False
) -> list[tuple[str, int, str, list[str]]]:
    """(type, year, round, paths) of each election found under ``root``.

    A folder is read as a whole unless some file in it is excluded.  What follows
    the year in a folder's name is the round.  Files in any other place are named
    in a warning, unless they are excluded, or in an error with ``strict``.
    """
    parts = [F.regexp_extract("folder", _FOLDERS, i) for i in (1, 2, 3)]
    kept = not_in(F.col("name"), list(exclude), keep_null=False)
    listed = parquet_datasets(spark, root)
    lost = listed.filter(~F.col("folder").rlike(_FOLDERS) & kept).select("dataset").limit(20).collect()
    if lost:
        message = f"not below {{type}}/{{year}}, not read: {', '.join(sorted(r[0] for r in lost))}"
        if strict:
            raise ValueError(message)
        warnings.warn(message, stacklevel=3)
    folders = (
        listed.filter(F.col("folder").rlike(_FOLDERS))
        .groupBy(
            parts[0].alias("election_type"),
            parts[1].cast("int").alias("annee"),
            parts[2].alias("round"),
            F.regexp_extract("dataset", r"^(.*)/[^/]+$", 1).alias("path"),
        )
        .agg(F.bool_and(kept).alias("whole"), F.collect_set(F.when(kept, F.col("dataset"))).alias("files"))
    )
    paths = F.when(F.col("whole"), F.array("path")).otherwise(F.col("files"))
    found = (
        folders.select("election_type", "annee", "round", F.explode(paths).alias("path"))
        .groupBy("election_type", "annee", "round")
        .agg(F.sort_array(F.collect_set("path")))
    )
    return sorted((r[0], r[1], r[2], list(r[3])) for r in found.collect())


def scan_elections(
    spark: SparkSession,
    root: str,
    vote_variables: Iterable[str],
    exclude: Iterable[str] = (),
    removed_communes: Iterable[str] = REMOVED_COMMUNES,
    strict: bool = False,
) -> DataFrame:
    """(codecommune, election_type, annee, round, inscrits, pvote{var}...).

    ``exclude`` lists file names to skip.  Each election is a scan of its own
    with a constant type and year, so a filter on them drops whole scans, and
    files of different elections may store a column with different types.
    Rows with a removed commune code go, rows without a code stay.
    """
    variables = list(vote_variables)
    scans = [
        spark.read.option("recursiveFileLookup", True).parquet(*paths).select(
            F.col("codecommune").cast("string").alias("codecommune"),
            F.lit(kind).alias("election_type"),
            F.lit(year).alias("annee"),
            F.lit(round_).alias("round"),
            nan_to_null(F.col("inscrits").cast("double")).alias("inscrits"),
            *[nan_to_null(F.col(quoted(v)).cast("double")).alias(f"pvote{v}") for v in variables],
        )
        for kind, year, round_, paths in election_files(spark, root, exclude, strict)
    ]
    if not scans:
        raise FileNotFoundError(f"no election files under {root}")
    rows = reduce(DataFrame.unionAll, scans)
    return rows.filter(not_in(F.col("codecommune"), removed_communes, keep_null=True))
