"""Exact ranks and quantiles inside groups of any size.

A group here is one (feature, year), and holds every entity.  When the largest
group fits one task comfortably, Spark's own window and ``percentile`` do the
work.  Beyond that no task ever holds a whole group:

* ranks: distinct values are counted, range-partitioned on (group, value) and
  written once; each slice is summed on its own and shifted by the total of the
  slices before it;
* quantiles: a sketch brackets each quantile within a narrow band, then only
  the band's values are counted and ranked exactly.  The sketch decides what is
  read, never what is returned.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.fixed_values import WINSOR_HIGH, WINSOR_LOW
from panelweave.functions.numbers import clip, nan_to_null
from panelweave.operators.columns import missing_counts, quoted
from panelweave.operators.joins import lookup_join
from panelweave.storage import (
    ROWS_PER_TASK,
    SMALL_TABLE_ROWS,
    pin_small,
    stage,
)

SKETCH_ACCURACY = 10_000
_BAND = 3.0 / SKETCH_ACCURACY


@dataclass(frozen=True)
class GroupSizes:
    """Non-NULL rows of the largest group and of all groups."""

    largest: int
    total: int


def group_sizes(df: DataFrame, groups: list[str], value: str) -> GroupSizes:
    per_group = df.groupBy(*groups).agg(F.count(value).alias("n"))
    top, total = per_group.agg(F.max("n"), F.sum("n")).first()
    return GroupSizes(int(top or 0), int(total or 0))


def cumulate(
    counts: DataFrame, groups: list[str], value: str, distinct: int, rows_per_task: int
) -> DataFrame:
    """Add ``below`` and ``total`` to (groups, value, copies), one row per value.

    ``below`` counts the copies of smaller values, a NULL value coming first;
    ``total`` all copies of the group.  ``distinct`` bounds the rows of
    ``counts`` and sizes the slices.
    """
    slices = max(2, ceil(2 * distinct / rows_per_task))
    sliced = stage(
        counts.repartitionByRange(
            slices, *groups, F.col(value).asc_nulls_first()
        ).withColumn("_slice", F.spark_partition_id()),
        "value-counts",
    )
    earlier = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = (
        sliced.groupBy(*groups, "_slice")
        .agg(F.sum("copies").alias("_in_slice"))
        .select(
            *groups,
            "_slice",
            F.coalesce(F.sum("_in_slice").over(earlier), F.lit(0)).alias("_shift"),
            F.sum("_in_slice").over(Window.partitionBy(*groups)).alias("total"),
        )
    )
    smaller = (
        Window.partitionBy(*groups, "_slice")
        .orderBy(F.col(value).asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    within = F.coalesce(F.sum("copies").over(smaller), F.lit(0))
    return (
        sliced.withColumn("_within", within)
        .join(shifts, [*groups, "_slice"])
        .select(*groups, value, "copies", (F.col("_shift") + F.col("_within")).alias("below"), "total")
    )


def _average_rank(below: Column, copies: Column, total: Column) -> Column:
    return (below + (copies + F.lit(1)) / F.lit(2.0)) / total


def rank_pct(
    df: DataFrame,
    groups: list[str],
    value: str,
    out: str = "rank_pct",
    rows_per_task: int = ROWS_PER_TASK,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Average rank of ties over the non-NULL count; NULL stays NULL."""
    sizes = sizes or group_sizes(df, groups, value)
    v = F.col(value)
    if sizes.largest <= rows_per_task:
        # frames of one window specification, hence one sort
        ordered = Window.partitionBy(*groups).orderBy(v.asc_nulls_last())
        ties = F.count(v).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
        everyone = F.count(v).over(
            ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        )
        rank = _average_rank(F.rank().over(ordered) - 1, ties, everyone)
        return df.withColumn(out, F.when(v.isNotNull(), rank))
    counts = df.filter(v.isNotNull()).groupBy(*groups, value).agg(F.count(v).alias("copies"))
    positions = cumulate(counts, groups, value, sizes.total, rows_per_task)
    rank = _average_rank(F.col("below"), F.col("copies"), F.col("total"))
    ranks = stage(positions.select(*groups, value, "copies", rank.alias(out)), "value-ranks")
    return _attach(df, ranks, [*groups, value], value, out, sizes.total, rows_per_task)


def _attach(df, ranks, keys, value, out, total, rows_per_task) -> DataFrame:
    """Join ranks back to rows although some values, or NULL, may be very common.

    Fewer than total/threshold values can have more than ``threshold`` copies,
    so those fit a broadcast.  Rows with such a value or with NULL need nothing
    from the second join; where they meet under a NULL key, adaptive execution
    splits their partition.
    """
    threshold = max(rows_per_task // 10, ceil(total / SMALL_TABLE_ROWS), 1)
    common = pin_small(
        ranks.filter(F.col("copies") > threshold).select(*keys, F.col(out).alias("_hot"))
    )
    rare = ranks.filter(F.col("copies") <= threshold).select(*keys, F.col(out).alias("_cold"))
    needs_join = F.col("_hot").isNull() & F.col(value).isNotNull()
    marked = df.join(common, keys, "left").withColumn("_key", F.when(needs_join, F.col(value)))
    other = [k for k in keys if k != value]
    joined = marked.join(rare.withColumnRenamed(value, "_key"), [*other, "_key"], "left")
    return joined.select(
        *[F.col(quoted(c)) for c in df.columns], F.coalesce("_hot", "_cold").alias(out)
    )


def _interpolate(total: Column, p: float, low: Column, high: Column) -> Column:
    """Written as Spark's ``percentile`` does it, so that both ways agree to the bit."""
    at = (total - 1) * F.lit(p)
    between = (F.ceil(at) - at) * low + (at - F.floor(at)) * high
    return F.when(low == high, low).otherwise(between)


def quantiles(
    df: DataFrame,
    groups: list[str],
    value: str,
    probabilities: list[float],
    names: list[str],
    rows_per_task: int = ROWS_PER_TASK,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, NULLs skipped.

    The result has one row per group and is pinned when that is small.
    """
    sizes = sizes or group_sizes(df, groups, value)
    if sizes.largest <= rows_per_task:
        found = df.groupBy(*groups).agg(F.percentile(value, list(probabilities)).alias("_q"))
        return pin_small(
            found.select(*groups, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
        )
    banded = pin_small(_band_quantiles(df, groups, value, probabilities, names, sizes, rows_per_task))
    uncovered = banded.filter((F.col("_n") > 0) & reduce(or_, [F.col(n).isNull() for n in names]))
    if not uncovered.isEmpty():
        banded = pin_small(
            _band_quantiles(df, groups, value, probabilities, names, sizes, rows_per_task, widest=True)
        )
    return pin_small(banded.drop("_n"))


def _band_quantiles(
    df, groups, value, probabilities, names, sizes, rows_per_task, widest=False
) -> DataFrame:
    """Quantiles found among the values of a band around each; NULL if outside.

    ``widest`` makes every band the whole group.
    """
    v = F.col(value)
    ends = [e for p in probabilities for e in (max(p - _BAND, 0.0), min(p + _BAND, 1.0))]
    if widest:
        ends = [0.0, 1.0] * len(probabilities)
    sketch = F.percentile_approx(v, ends, SKETCH_ACCURACY)
    bands = pin_small(df.groupBy(*groups).agg(sketch.alias("_ends"), F.count(v).alias("_n")))
    steps = range(len(probabilities))
    banded = lookup_join(df.select(*groups, value).filter(v.isNotNull()), bands, groups)
    low, high = [F.col("_ends")[2 * i] for i in steps], [F.col("_ends")[2 * i + 1] for i in steps]
    # the few rows inside a band are counted by value, the many below it by number
    in_band = banded.filter(reduce(or_, [(v >= low[i]) & (v <= high[i]) for i in steps])).select(
        *groups,
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("_i"), F.when((v >= low[i]) & (v <= high[i]), v).alias("_v"))
            for i in steps
        ])),
    )
    by_value = in_band.filter(F.col("_v").isNotNull()).groupBy(*groups, "_i", "_v").agg(
        F.count(F.lit(1)).alias("copies")
    )
    under = banded.groupBy(*groups).agg(*[F.count_if(v < low[i]).alias(f"u{i}") for i in steps]).select(
        *groups,
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("_i"), F.lit(None).cast(df.schema[value].dataType).alias("_v"),
                     F.col(f"u{i}").alias("copies"))
            for i in steps
        ])),
    )
    counts = by_value.unionAll(under)
    width = 1.0 if widest else min(1.0, 4 * _BAND)
    expected = ceil(sizes.total * len(probabilities) * width)
    positions = lookup_join(
        cumulate(counts, [*groups, "_i"], "_v", expected, rows_per_task).drop("total"), bands, groups
    )
    picked = []
    for i, p in enumerate(probabilities):
        at = (F.col("_n") - 1) * F.lit(p)
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            covers = (
                (F.col("_i") == i)
                & (F.col("below") <= index)
                & (index < F.col("below") + F.col("copies"))
            )
            picked.append(F.max(F.when(covers, F.col("_v"))).alias(f"_{side}{i}"))
    found = positions.groupBy(*groups).agg(*picked)
    return bands.select(*groups, "_n").join(found, groups, "left").select(
        *groups,
        "_n",
        *[
            _interpolate(F.col("_n"), p, F.col(f"_lo{i}"), F.col(f"_hi{i}")).alias(n)
            for i, (p, n) in enumerate(zip(probabilities, names))
        ],
    )


def winsorize(
    df: DataFrame,
    groups: list[str],
    value: str,
    out: str = "winsor",
    low: float = WINSOR_LOW,
    high: float = WINSOR_HIGH,
    rows_per_task: int = ROWS_PER_TASK,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Clip to the group's own quantiles; the bounds are one row per group."""
    bounds = quantiles(df, groups, value, [low, high], ["_low", "_high"], rows_per_task, sizes)
    joined = lookup_join(df, bounds, groups)
    return joined.withColumn(out, clip(F.col(value), F.col("_low"), F.col("_high"))).drop(
        "_low", "_high"
    )


def medians(
    df: DataFrame,
    columns: list[str],
    rows_per_task: int = ROWS_PER_TASK,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """(column, median) of numeric columns, from one unpivoted pass."""
    long = df.select(*[nan_to_null(F.col(quoted(c)).cast("double")).alias(c) for c in columns]).unpivot(
        [], columns, "column", "value"
    )
    return quantiles(long, ["column"], "value", [0.5], ["median"], rows_per_task, sizes)


def impute_medians(
    df: DataFrame, columns: list[str], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Fill missing values of ``columns`` with the column's median.

    Columns are counted first; those without a gap need no median.
    """
    rows, missing = missing_counts(df.select(*[quoted(c) for c in columns]))
    gappy = [c for c in columns if missing[c]]
    middle = {}
    if gappy:
        present = [rows - missing[c] for c in gappy]
        found = medians(df, gappy, rows_per_task, GroupSizes(max(present), sum(present)))
        middle = {r["column"]: r["median"] for r in found.collect()}
    filled = {c: nan_to_null(F.col(quoted(c)).cast("double")) for c in columns}
    for c, median in middle.items():
        filled[c] = F.coalesce(filled[c], F.lit(median).cast("double"))
    return df.withColumns(filled)
