"""Projected and filtered Parquet scans; pruning and pushdown are Spark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.fixed_values import STARTING_YEAR
from panelweave.functions.predicates import complete
from panelweave.operators.columns import quoted


def scan_projected(
    spark: SparkSession,
    path: str,
    columns: list[str],
    dropna_subset: list[str] | None = None,
    predicate: Column | None = None,
) -> DataFrame:
    """``columns`` of the rows that are complete on ``dropna_subset`` and pass.

    The predicate may use kept and null-checked columns only.
    """
    needed = list(dict.fromkeys([*columns, *(dropna_subset or [])]))
    rows = spark.read.parquet(path).select(*[quoted(c) for c in needed])
    if dropna_subset:
        rows = rows.filter(complete(dropna_subset))
    if predicate is not None:
        rows = rows.filter(predicate)
    return rows.select(*[quoted(c) for c in columns])


def scan_year_filter(
    spark: SparkSession, path: str, starting_year: int = STARTING_YEAR, year_col: str = "annee"
) -> DataFrame:
    """Rows strictly after ``starting_year``; older row groups are skipped."""
    return spark.read.parquet(path).filter(F.col(quoted(year_col)) > starting_year)
