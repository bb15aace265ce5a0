"""Shared-folder staging and size-checked small tables.

Two rules live here.  Intermediate results that must be read more than once
are written as tables to the folder named by ``spark.checkpoint.dir``, so a
lost executor costs a re-read and never a wrong answer.  A table is pinned or
broadcast only after its row count has been checked.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_TABLE_ROWS = 100_000
ROWS_PER_TASK = 1_000_000

_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, private to this application."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    app = spark.sparkContext.applicationId
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        if app not in _local_folders:
            _local_folders[app] = tempfile.mkdtemp(prefix="panelweave-")
        base = _local_folders[app]
    return f"{base.rstrip('/')}/{app}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of the result."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_alone(df: DataFrame, name: str) -> DataFrame:
    """``stage`` that leaves no shuffle files behind, rather than until the driver collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_DROP_SHUFFLES, None)
    conf.set(_DROP_SHUFFLES, "true")
    try:
        return stage(df, name)
    finally:
        if before is None:
            conf.unset(_DROP_SHUFFLES)
        else:
            conf.set(_DROP_SHUFFLES, before)


def pinned(df: DataFrame, max_rows: int = SMALL_TABLE_ROWS) -> DataFrame | None:
    """A metadata table as broadcast literals, or None beyond ``max_rows`` rows.

    Reading stops one row past the limit, so the driver's share is bounded.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema=df.schema))


def pin_small(df: DataFrame, max_rows: int = SMALL_TABLE_ROWS) -> DataFrame:
    """``pinned`` where possible; a larger table comes back untouched and
    unhinted, so that joins with it shuffle."""
    local = pinned(df, max_rows)
    return df if local is None else local


def is_small(df: DataFrame, max_rows: int = SMALL_TABLE_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows

