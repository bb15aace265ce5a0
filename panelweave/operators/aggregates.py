"""Grouped sums, counts and the long-to-wide step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.predicates import complete
from panelweave.operators.columns import quoted
from panelweave.operators.periods import with_neighbours


def sum_by(
    df: DataFrame, keys: list[str], sums: list[str], firsts: list[str] | None = None
) -> DataFrame:
    """Sums per key; rows without a full key are dropped and an all-NULL sum is 0.

    ``firsts`` are descriptive columns; the smallest non-NULL value stands for
    the group.  They are strings, which Spark can only aggregate by sorting, so
    the sums are first reduced with the descriptive columns as extra keys.
    """
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]
    detail = df.filter(complete(keys))
    if not firsts:
        return detail.groupBy(*keys).agg(*totals)
    reduced = detail.groupBy(*keys, *firsts).agg(*totals)
    return reduced.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in firsts]
    )


def pivot_sum(
    df: DataFrame, keys: list[str], column: str, names: dict[str, str], value: str
) -> DataFrame:
    """Sum ``value`` into one column per listed label, 0 where a label is absent.

    Conditional sums are written out so that the map side combines them and
    detail rows cross the network once.
    """
    sums = [
        F.coalesce(F.sum(F.when(F.col(column) == label, F.col(value))), F.lit(0)).alias(name)
        for label, name in names.items()
    ]
    return df.filter(complete([*keys, column])).groupBy(*keys).agg(*sums)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each value, NULL included, most frequent first."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_last(column))


def distinct_sorted(df: DataFrame, column: str, keep_null: bool = False) -> DataFrame:
    values = df.select(column) if keep_null else df.select(column).filter(complete([column]))
    return values.distinct().orderBy(F.asc_nulls_last(column))


def only_value(column: str, what: str) -> Column:
    """Aggregate that returns the group's single value and fails on a second row."""
    clash = F.raise_error(F.lit(f"{what}: two rows for one cell")).cast("double")
    return F.when(F.count(F.lit(1)) > 1, clash).otherwise(F.max(quoted(column)))


def label_values(df: DataFrame, label: str, max_columns: int = 20_000) -> list[str]:
    """Sorted labels that will become columns; refuses an unbounded column list."""
    rows = df.select(label).filter(complete([label])).distinct().limit(max_columns + 1).collect()
    if len(rows) > max_columns:
        raise ValueError(f"more than {max_columns} distinct values of {label}")
    return sorted(r[0] for r in rows)


def widen(
    long: DataFrame, keys: list[str], label: str, value: str, labels: list[str] | None = None
) -> DataFrame:
    """One row per key and one column per label, from one exchange.

    Stands for a chain of full outer joins, one per input file: rows with a
    NULL key meet in one row, and two values for a cell are an error.
    """
    labels = label_values(long, label) if labels is None else labels
    cell = only_value(value, f"widen {value}").alias(value)
    return _by_key(long, keys).groupBy(*[quoted(k) for k in keys]).pivot(label, labels).agg(cell)


def _by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash rows on the keys alone.

    A pivot aggregates twice, by (keys, label) and by keys.  Cells are unique,
    so combining before the exchange saves nothing; hashing on the keys lets one
    exchange serve both.
    """
    return df.repartition(*[F.col(quoted(k)) for k in keys])


def widen_votes(votes: DataFrame, vote_columns: list[str]) -> DataFrame:
    """Votes per commune with ``{column}{year}-{type}`` names."""
    labelled = votes.withColumn(
        "_election", F.concat_ws("-", F.col("annee").cast("string"), "election_type")
    )
    elections = label_values(labelled, "_election")
    measures = ["inscrits", *vote_columns]
    cells = [only_value(c, f"votes {c}").alias(c) for c in measures]
    wide = _by_key(labelled, ["codecommune"]).groupBy("codecommune").pivot("_election", elections).agg(*cells)
    ordered = [
        F.col(quoted(f"{e}_{c}")).alias(f"{c}{e}") for e in elections for c in measures
    ]
    return wide.select("codecommune", *ordered)


def mean_of_means(votes: DataFrame, vote_columns: list[str]) -> DataFrame:
    """(election_type, var, mean): plain mean over years of each year's mean."""
    yearly = votes.groupBy("election_type", "annee").agg(
        *[F.avg(c).alias(c) for c in vote_columns]
    )
    means = yearly.groupBy("election_type").agg(*[F.avg(c).alias(c) for c in vote_columns])
    return means.unpivot("election_type", vote_columns, "var", "mean")


def election_catalog(votes: DataFrame) -> DataFrame:
    """Elections present, with the one before of the same type."""
    per_election = votes.groupBy("election_type", "annee").agg(F.count(F.lit(1)).alias("communes"))
    return with_neighbours(per_election, ["election_type"], "annee").drop("next_annee")
