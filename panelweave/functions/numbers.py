"""Guarded arithmetic with the missing-value rules of the panel."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def row_total(columns: list[str]) -> Column:
    """Sum across columns; a missing part counts as zero."""
    return reduce(add, (F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in columns))


def share_or_zero(part: Column, total: Column) -> Column:
    return F.when(total != 0, part / total).otherwise(F.lit(0.0))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """0 for a zero denominator, NULL for a missing one."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def gini_simpson(parts: list[str], total: Column) -> Column:
    """Diversity of a composition: one minus the sum of squared shares."""
    squares = (
        F.coalesce(F.try_divide(F.col(f"`{c}`") * F.col(f"`{c}`"), total * total), F.lit(0.0))
        for c in parts
    )
    return F.lit(1.0) - reduce(add, squares)


def relative_change(value: Column, previous: Column) -> Column:
    return F.when(previous != 0, (value - previous) / previous)


def clip(value: Column, low: Column, high: Column) -> Column:
    """Bound a value; ``greatest``/``least`` skip NULLs, so guard the value."""
    return F.when(value.isNotNull(), F.greatest(low, F.least(high, value)))
