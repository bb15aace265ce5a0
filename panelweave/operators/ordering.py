"""Consecutive numbers in a total order."""

from __future__ import annotations

from itertools import accumulate
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.columns import quoted
from panelweave.storage import ROWS_PER_TASK, stage


def number_in_order(df: DataFrame, order: list[str], out: str = "row_number", start: int = 1, rows_per_slice: int = ROWS_PER_TASK // 4) -> DataFrame:
    """``df`` with consecutive numbers from ``start`` in the order of ``order``, NULLs first.

    Rows are cut into ranges that are written once; a range is numbered by
    itself and shifted by the rows of the ranges before it, so no task sees all
    rows.  The driver holds a count a range.  ``order`` should tell rows apart:
    equal rows are numbered in any order, and stay in one range.
    """
    keys = [F.col(quoted(c)).asc_nulls_first() for c in order]
    slices = max(1, ceil(df.count() / rows_per_slice))
    cut = stage(df.repartitionByRange(slices, *keys).withColumn("_slice", F.spark_partition_id()), "ranges")
    counts = sorted((r["_slice"], r["n"]) for r in cut.groupBy("_slice").agg(F.count(F.lit(1)).alias("n")).collect())
    before = [0, *accumulate(n for _, n in counts)]
    shifts = df.sparkSession.createDataFrame([(s, start - 1 + b) for (s, _), b in zip(counts, before)], "_slice int, _shift long")
    within = F.row_number().over(Window.partitionBy("_slice").orderBy(*keys))
    numbered = cut.join(F.broadcast(shifts), "_slice").withColumn(out, F.col("_shift") + within)  # a row a range
    return numbered.select(*[F.col(quoted(c)) for c in df.columns if c != out], F.col(quoted(out)))
