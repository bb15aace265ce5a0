"""Joins with the panel's key rules: NULL keys, uniqueness and hot keys."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.predicates import complete
from panelweave.operators.columns import quoted
from panelweave.storage import SMALL_TABLE_ROWS, pinned


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Equi-join in which a NULL key matches a NULL key."""
    a, b = left.alias("a"), right.alias("b")
    same = reduce(
        and_, (F.col(f"a.{quoted(k)}").eqNullSafe(F.col(f"b.{quoted(k)}")) for k in on)
    )
    keys = [F.coalesce(f"a.{quoted(k)}", f"b.{quoted(k)}").alias(k) for k in on]
    if how in ("left", "inner"):
        keys = [F.col(f"a.{quoted(k)}") for k in on]
    rest = [F.col(f"a.{quoted(c)}") for c in left.columns if c not in on]
    rest += [F.col(f"b.{quoted(c)}") for c in right.columns if c not in on]
    return a.join(b, same, how).select(*keys, *rest)


def require_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """The same rows, failing at run time if a key (NULL included) repeats.

    Rows of a key are numbered, which sorts them by the key alone, and a second
    one is an error.  It leaves the data hashed and sorted on ``keys``, so a
    join on them adds neither exchange nor sort.
    """
    by_key = [F.col(quoted(k)) for k in keys]
    repeated = F.concat(
        F.lit(f"{what}: more than one row for key ("),
        F.concat_ws(", ", *[F.coalesce(k.cast("string"), F.lit("NULL")) for k in by_key]),
        F.lit(")"),
    )
    numbered = df.withColumn("_copy", F.row_number().over(Window.partitionBy(*by_key).orderBy(*by_key)))
    ok = F.when(F.col("_copy") == 1, F.lit(True)).otherwise(F.raise_error(repeated).cast("boolean"))
    return numbered.filter(ok).drop("_copy")


def join_one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join that fails unless both sides are unique on the key."""
    return join_null_safe(
        require_unique(left, on, "left side"), require_unique(right, on, "right side"), on, "left"
    )


def lookup_join(
    df: DataFrame, table: DataFrame, on: list[str], max_rows: int = SMALL_TABLE_ROWS
) -> DataFrame:
    """Left join with a lookup table, as a rule unique on ``on``.

    A checked-small table is broadcast.  With a larger one both sides are
    exchanged, and adaptive execution splits the detail rows of a key that holds
    a large part of them, or of the NULL key, over many tasks.
    """
    small = pinned(table, max_rows)
    return df.join(table if small is None else small, on, "left")


def semi_keep_null(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows whose key occurs on the right, plus all rows without a key.

    The left side is read once: a left join marks the known keys.
    """
    known = right.select(F.col(on).alias("_known")).filter(complete(["_known"])).distinct()
    marked = left.join(known, F.col(quoted(on)) == F.col("_known"), "left")
    return marked.filter(F.col(quoted(on)).isNull() | F.col("_known").isNotNull()).drop("_known")


def set_difference(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Distinct non-NULL keys of ``left`` that ``right`` lacks."""
    return (
        left.select(on).filter(complete([on])).distinct()
        .join(right.select(on).filter(complete([on])).distinct(), on, "left_anti")
    )


def union_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Stack tables; a column some of them lack is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, first)
