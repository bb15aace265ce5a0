"""Covariate files: one prefixed group of dated columns per file."""

from __future__ import annotations

from collections.abc import Collection, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.fixed_values import UNDATED_FEATURE_FILES
from panelweave.functions.names import (
    YEAR_AT_END,
    feature_stem,
    feature_year,
    move_year_to_end,
    with_default_year,
)
from panelweave.functions.numbers import nan_to_null
from panelweave.functions.predicates import name_matches
from panelweave.operators.columns import quoted
from panelweave.sources.listing import dataset_versions, parquet_datasets


def covariate_files(
    spark: SparkSession, root: str, include: str = "communes", skip: str = "code"
) -> list[tuple[str, str]]:
    """(dataset path, stem) of each matching file under ``root``."""
    stem = F.regexp_replace("name", r"\.parquet$", "")
    found = (
        parquet_datasets(spark, root).select("dataset", stem.alias("stem"))
        .filter(name_matches(F.col("stem"), include, skip))
    )
    return sorted((r["dataset"], r["stem"]) for r in found.collect())


def dated_columns(spark: SparkSession, columns: Iterable[tuple[str, str]]) -> dict:
    """(stem, column) -> (feature, year) for every column that has a year."""
    names = spark.createDataFrame(list(columns), "stem string, column string")
    feature = F.when(
        F.col("stem").rlike(YEAR_AT_END), move_year_to_end(F.col("column"))
    ).otherwise(F.col("column"))
    for stem, year, keys in UNDATED_FEATURE_FILES:
        feature = F.when(
            F.col("stem") == stem, with_default_year(feature, year, keys)
        ).otherwise(feature)
    dated = names.withColumn("named", feature).filter(feature_year(F.col("named")).isNotNull())
    rows = dated.select(
        "stem", "column",
        feature_stem(F.col("named")).alias("feature"), feature_year(F.col("named")).alias("annee"),
    ).collect()
    return {(r["stem"], r["column"]): (r["feature"], r["annee"]) for r in rows}


def covariate_versions(spark: SparkSession, root: str, include: str = "communes", skip: str = "code") -> dict[str, str]:
    """Dataset path -> version of each matching file, from the listing alone."""
    stem = F.regexp_replace("name", r"\.parquet$", "")
    found = dataset_versions(spark, root).filter(name_matches(stem, include, skip))
    return {r["dataset"]: r["version"] for r in found.collect()}  # a row a file


def scan_covariates(
    spark: SparkSession,
    root: str,
    include: str = "communes",
    skip: str = "code",
    text: str = "error",
    only: Collection[str] | None = None,
    source: str | None = None,
) -> DataFrame:
    """(codecommune, feature, annee, value) over all files, feature = ``stem/name``.

    Long form replaces the outer join per file: the files are stacked, and one
    exchange widens them when a wide table is wanted.  NULLs are kept so that
    the catalog of years stays complete.  Files of one name in different folders
    are all read; a year that two of them give fails where it is widened.
    Dated text columns are named in an error, or with ``text="keep"`` arrive in
    a column ``text``, which is then always there; ``text="drop"`` leaves them out.
    ``only`` names the files to read; ``source`` is a column for their path.
    """
    chosen = [(path, stem) for path, stem in covariate_files(spark, root, include, skip) if only is None or path in only]
    files = [(stem, spark.read.parquet(path)) for path, stem in chosen]
    if not files:
        raise FileNotFoundError(f"no {include} files under {root}")
    dated = dated_columns(spark, sorted({(s, c) for s, df in files for c in df.columns}))
    wordy = [
        f"{stem}/{c}" for stem, df in files for c in df.columns
        if (stem, c) in dated and c != "codecommune" and isinstance(df.schema[c].dataType, T.StringType)
    ]
    if wordy and text == "error":
        raise ValueError(f"dated text columns: {', '.join(wordy)}; pass text='keep' or text='drop'")
    words = {"text": "string"} if text == "keep" else {}
    parts = []
    for (path, _), (stem, df) in zip(chosen, files):
        cells = [
            F.struct(
                F.lit(f"{stem}/{dated[stem, c][0]}").alias("feature"),
                F.lit(dated[stem, c][1]).alias("annee"),
                nan_to_null(F.col(quoted(c)).try_cast("double")).alias("value"),
                *[(F.col(quoted(c)) if f"{stem}/{c}" in wordy else F.lit(None)).cast(t).alias(n) for n, t in words.items()],
            )
            for c in df.columns
            if (stem, c) in dated and c != "codecommune" and (text == "keep" or f"{stem}/{c}" not in wordy)
        ]
        if cells:
            parts.append(
                df.select(
                    *([F.lit(path).alias(source)] if source else []),
                    F.col("codecommune").cast("string").alias("codecommune"),
                    F.inline(F.array(*cells)),
                )
            )
    return reduce(DataFrame.unionByName, parts)
