"""Previous-period features over irregular periods.

"Previous" is a property of the catalog of (feature, year) pairs, not of one
entity's rows: a commune without a value in the previous catalog year has no
previous value, even if it has an older one.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.numbers import relative_change
from panelweave.operators.columns import quoted
from panelweave.storage import pin_small


def with_neighbours(catalog: DataFrame, feature: list[str], year: str) -> DataFrame:
    """Catalog rows with the year before and after; groups hold years only."""
    w = Window.partitionBy(*feature).orderBy(year)
    return catalog.withColumns(
        {f"prev_{year}": F.lag(year).over(w), f"next_{year}": F.lead(year).over(w)}
    )


def period_catalog(df: DataFrame, feature: list[str], year: str) -> DataFrame:
    """Distinct (feature, year) with neighbours, pinned when it is small."""
    return pin_small(with_neighbours(df.select(*feature, year).distinct(), feature, year))


def _one_row_per_period(year: str, w, what: str) -> Column:
    """True, or an error at run time when a window holds a period twice.

    Peers are counted, not years compared: the optimizer may put a constant
    from a later filter in place of the year.
    """
    peers = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    clash = F.raise_error(F.lit(f"{what}: two rows for one {year}")).cast("boolean")
    return F.when(peers > 1, clash).otherwise(F.lit(True))


def with_previous(
    df: DataFrame,
    entity: str,
    feature: list[str],
    year: str,
    values: list[str],
    catalog: DataFrame | None = None,
) -> DataFrame:
    """Add ``prev_{value}`` for each value column.

    The input may be sparse.  Where an entity has a value in one catalog year
    and no row in the next, that next row is emitted with NULL values and its
    previous value, so the result equals the one on the full entity x catalog
    grid (less its all-NULL rows) without building the grid.
    Rows are grouped by (entity, feature); a group holds one row per year, and
    a repeated year is an error.
    """
    if catalog is None:
        catalog = period_catalog(df, feature, year)
    dated = df.select(entity, *feature, year, *values).join(catalog, [*feature, year])
    w = Window.partitionBy(entity, *feature).orderBy(year)
    follows = F.lag(year).over(w) == F.col(f"prev_{year}")
    nothing_next = F.col(f"next_{year}").isNotNull() & F.coalesce(
        F.lead(year).over(w) != F.col(f"next_{year}"), F.lit(True)
    )
    has_value = reduce(or_, (F.col(v).isNotNull() for v in values))
    looked = dated.select(
        "*",
        *[F.when(follows, F.lag(v).over(w)).alias(f"prev_{v}") for v in values],
        (nothing_next & has_value).alias("_carry"),
        _one_row_per_period(year, w, "features").alias("_unique"),
    ).filter("_unique")
    own = F.struct(
        F.col(year), *[F.col(v) for v in values], *[F.col(f"prev_{v}") for v in values]
    )
    carried = F.struct(
        F.col(f"next_{year}").alias(year),
        *[F.lit(None).cast(df.schema[v].dataType).alias(v) for v in values],
        *[F.col(v).alias(f"prev_{v}") for v in values],
    )
    rows = F.when(F.col("_carry"), F.array(own, carried)).otherwise(F.array(own))
    return looked.select(entity, *feature, F.inline(rows))


def lag_feature(previous: DataFrame, value: str = "value", out: str = "lag") -> DataFrame:
    return previous.withColumn(out, F.col(f"prev_{value}"))


def delta_feature(previous: DataFrame, value: str = "value", out: str = "delta") -> DataFrame:
    return previous.withColumn(out, F.col(value) - F.col(f"prev_{value}"))


def pct_change_feature(
    previous: DataFrame, value: str = "value", out: str = "pct_change"
) -> DataFrame:
    return previous.withColumn(out, relative_change(F.col(value), F.col(f"prev_{value}")))


def with_previous_elections(
    votes: DataFrame, vote_columns: list[str], catalog: DataFrame | None = None
) -> DataFrame:
    """Add each share's value at the last and last-but-one election of the type.

    One exchange on (commune, type); a group holds one row per election year,
    and a repeated year is an error.
    """
    if catalog is None:
        catalog = election_history(votes)
    dated = votes.join(catalog, ["election_type", "annee"])
    w = Window.partitionBy("codecommune", "election_type").orderBy("annee")
    seen = [(F.lag("annee", n).over(w), n) for n in (1, 2)]

    def at(wanted: str, column: str):
        return F.coalesce(
            *[F.when(y == F.col(wanted), F.lag(column, n).over(w)) for y, n in seen]
        )

    added = {"_unique": _one_row_per_period("annee", w, "votes")}
    for c in vote_columns:
        base = c.removeprefix("pvote")
        added[f"pvoteprevious{base}"] = at("_year_1", c)
        added[f"pvotepreviousprevious{base}"] = at("_year_2", c)
    looked = dated.withColumns(added).filter("_unique")
    return looked.select(*[quoted(c) for c in votes.columns], *[c for c in added if c != "_unique"])


def election_history(votes: DataFrame) -> DataFrame:
    """(election_type, annee, year before, year before that)."""
    w = Window.partitionBy("election_type").orderBy("annee")
    return pin_small(
        votes.select("election_type", "annee").distinct().withColumns(
            {"_year_1": F.lag("annee", 1).over(w), "_year_2": F.lag("annee", 2).over(w)}
        )
    )
