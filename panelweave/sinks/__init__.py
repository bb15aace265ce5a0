"""Parquet and CSV outputs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.config import PanelConfig
from panelweave.operators.columns import quoted
from panelweave.storage import is_small


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Write an intermediate table and go on from the written copy."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dataset_name(cfg: PanelConfig, at: datetime | None = None) -> str:
    """data_{variables}_{min year}_{elections}_{timestamp}.parquet"""
    stamp = (at or datetime.now()).strftime("%Y%m%d_%H%M%S")
    parts = ["data", *cfg.vote_variables, str(cfg.min_year), *cfg.include_elections, stamp]
    return "_".join(parts) + ".parquet"


def write_versioned(
    df: DataFrame,
    cfg: PanelConfig,
    partition_by: tuple[str, ...] = ("type", "annee"),
    at: datetime | None = None,
) -> str:
    """Write a dataset under a new name, partitioned for later type/year pruning.

    The rebalance hint gathers each partition's rows into few files, and splits
    a partition that is much larger than the others over several tasks.
    """
    path = f"{cfg.output_dir.rstrip('/')}/{dataset_name(cfg, at)}"
    keys = [F.col(quoted(c)) for c in partition_by]
    (df.hint("rebalance", *keys) if keys else df).write.partitionBy(*partition_by).parquet(path)
    return path


def write_sorted_csv(df: DataFrame, path: str, by: str) -> None:
    """Sorted CSV with a header, NULLs last; a lookup-sized table is one file."""
    ordered = df.orderBy(F.asc_nulls_last(quoted(by)))
    if is_small(df):
        ordered = ordered.coalesce(1)
    ordered.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
