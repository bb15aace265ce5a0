"""Code -> label lookups with fallback tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.predicates import complete
from panelweave.operators.joins import lookup_join


def last_wins(table: DataFrame, key: str | list[str], value: str, position: str) -> DataFrame:
    """One row per key: the value of its last row, even when that is NULL."""
    keys = [key] if isinstance(key, str) else key
    return table.filter(complete(keys)).groupBy(*keys).agg(F.max_by(value, position).alias(value))


def unknown_labels(table: DataFrame, value: str, allowed: Iterable[str]) -> DataFrame:
    """Rows of a lookup table whose label is not in the vocabulary."""
    return table.filter(~F.col(value).isin(*allowed))


def lookup(
    df: DataFrame, tables: list[DataFrame], on: str | list[str], value: str, out: str
) -> DataFrame:
    """Label rows from the first table that has a non-NULL value for the code.

    The tables are merged into one before the detail rows are touched, so the
    detail is joined once however many fallbacks there are.
    """
    keys = [on] if isinstance(on, str) else on
    ranked = [
        t.select(*keys, F.col(value).alias(out), F.lit(i).alias("_rank")) for i, t in enumerate(tables)
    ]
    merged = (
        reduce(DataFrame.unionAll, ranked)
        .filter(F.col(out).isNotNull())
        .groupBy(*keys)
        .agg(F.min_by(out, "_rank").alias(out))
    )
    return lookup_join(df, merged, keys)
