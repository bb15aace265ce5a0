"""Computed-once tables on disk."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cached(
    spark: SparkSession,
    folder: str,
    key: str,
    build: Callable[[], DataFrame],
    use_cached: bool = True,
    partition_by: tuple[str, ...] = (),
) -> DataFrame:
    """The table stored for ``key``, built and stored if it is not there.

    ``key`` digests the settings the table depends on, so changed settings make
    a new table.  A finished table, told by a marker written behind it, is never
    overwritten; with ``use_cached`` off the result is computed afresh and left
    unread on disk.  What a broken write left behind is written over.
    Partitioned tables let later reads skip whole folders.
    """
    path = f"{folder.rstrip('/')}/{key}.parquet"
    marker = f"{folder.rstrip('/')}/{key}.done"
    stored = stored_table(spark, path) if stored_table(spark, marker) is not None else None
    if use_cached and stored is not None:
        return stored
    result = build()
    if stored is not None:
        return result
    # rebalance: few files per partition, and large partitions split over tasks
    spread = result.hint("rebalance", *partition_by) if partition_by else result
    spread.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    spark.range(1).write.mode("overwrite").parquet(marker)
    return spark.read.schema(result.schema).parquet(path)


@dataclass(frozen=True)
class Refreshed:
    """A cached table, its catalog, and the inputs that had to be built."""

    rows: DataFrame
    catalog: DataFrame
    built: tuple[str, ...]


def refreshed(
    spark: SparkSession,
    folder: str,
    key: str,
    versions: dict[str, str],
    build: Callable[[list[str]], DataFrame],
    catalog: tuple[str, ...],
    value: str,
    use_cached: bool = True,
    partition_by: tuple[str, ...] = (),
) -> Refreshed:
    """The table made of the inputs named in ``versions``, kept input by input.

    ``build`` gives the rows of some inputs, with the input's name in a column
    ``_input``.  Inputs whose version is not the stored one are built and take
    the place of their own partitions; inputs that are gone are no longer read.
    The manifest is written last, so what a broken run left is built again.
    ``catalog`` names the columns whose combinations, with their rows and
    missing values, are kept beside the table; reading them scans no data.
    """
    base = f"{folder.rstrip('/')}/{key}"
    parts = {name: hashlib.md5(f"{name}|{version}".encode()).hexdigest()[:16] for name, version in versions.items()}
    manifest = stored_table(spark, f"{base}.manifest")
    known = {} if manifest is None or not use_cached else {r["input"]: r["part"] for r in manifest.collect()}  # a row an input
    if known and stored_table(spark, f"{base}.parquet") is None:
        known = {}
    changed = sorted(name for name, part in parts.items() if known.get(name) != part)
    counts = stored_table(spark, f"{base}.catalog") if known else None
    if changed or counts is None:
        changed = changed if counts is not None else sorted(parts)
        names = spark.createDataFrame([(n, parts[n]) for n in changed], "_input string, _part string")
        rows = build(changed).join(F.broadcast(names), "_input").drop("_input")  # a row an input
        spread = rows.hint("rebalance", "_part", *partition_by)
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part", *partition_by).parquet(f"{base}.parquet")
        fresh = _read_parts(spark, f"{base}.parquet", [parts[n] for n in changed], rows)
        missing = F.count_if(F.col(value).isNull()).alias("missing")
        counted = fresh.groupBy("_part", *catalog).agg(F.count(F.lit(1)).alias("rows"), missing)
        if counts is not None:
            kept = counts.filter(F.col("_part").isin([p for n, p in parts.items() if n not in changed]))
            counted = counted.unionByName(kept.select(*counted.columns))
        # a small table that replaces one it is read from: through the driver's memory
        counted = spark.createDataFrame(counted.toArrow(), schema=counted.schema)
        counted.write.mode("overwrite").parquet(f"{base}.catalog")
        entries = [(n, versions[n], parts[n]) for n in sorted(parts)]
        spark.createDataFrame(entries, "input string, version string, part string").coalesce(1).write.mode("overwrite").parquet(f"{base}.manifest")
    elif set(known) != set(parts):
        entries = [(n, versions[n], parts[n]) for n in sorted(parts)]
        spark.createDataFrame(entries, "input string, version string, part string").coalesce(1).write.mode("overwrite").parquet(f"{base}.manifest")
    in_use = sorted(parts.values())
    rows = _read_parts(spark, f"{base}.parquet", in_use, rows if changed else None).drop("_part")
    counts = spark.read.parquet(f"{base}.catalog").filter(F.col("_part").isin(in_use))
    totals = counts.groupBy(*catalog).agg(F.sum("rows").alias("rows"), F.sum("missing").alias("missing"))
    return Refreshed(rows, totals, tuple(changed))


def _read_parts(spark: SparkSession, path: str, parts: list[str], like: DataFrame | None = None) -> DataFrame:
    reader = spark.read if like is None else spark.read.schema(like.schema)
    return reader.parquet(path).filter(F.col("_part").isin(parts))


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
