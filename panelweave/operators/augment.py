"""Rank, winsor and previous-period variants of every feature."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.fixed_values import AUGMENTATION_SUFFIXES
from panelweave.functions.numbers import relative_change
from panelweave.operators.distribution import GroupSizes, rank_pct, winsorize
from panelweave.operators.periods import with_neighbours, with_previous
from panelweave.storage import ROWS_PER_TASK, pin_small

_GROUP = ["feature", "annee"]


def augment(
    features: DataFrame, kinds: Iterable[str], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """One column per chosen kind next to (codecommune, feature, annee).

    ``features`` is (codecommune, feature, annee, value), unique on the first
    three.  Kinds built on winsorised values compute them without being asked.
    Ranks and quantiles group by (feature, year); previous values group by
    (commune, feature): at most one exchange of the rows for each.  A first
    pass counts the groups; it serves as catalog and tells how large they are.
    """
    kinds = list(kinds)
    counted = features.groupBy(*_GROUP).agg(F.count("value").alias("_n"))
    catalog = pin_small(with_neighbours(counted, ["feature"], "annee"))
    largest, total = catalog.agg(F.max("_n"), F.sum("_n")).first()
    sizes = GroupSizes(int(largest or 0), int(total or 0))
    on_winsor = {"winsor", "deltawinsor", "lagwinsor", "pct_changewinsor"} & set(kinds)
    on_previous = set(kinds) - {"raw", "rank", "winsor"}
    table = features.select("codecommune", *_GROUP, "value")
    carried = ["value"]
    if on_winsor:
        table = winsorize(
            table, _GROUP, "value", "winsor", rows_per_task=rows_per_task, sizes=sizes
        )
        carried.append("winsor")
    if "rank" in kinds:
        table = rank_pct(table, _GROUP, "value", "rank", rows_per_task, sizes)
        carried.append("rank")
    if on_previous:
        table = with_previous(
            table, "codecommune", ["feature"], "annee", carried, catalog.drop("_n")
        )
    built = {
        "raw": lambda: F.col("value"),
        "rank": lambda: F.col("rank"),
        "winsor": lambda: F.col("winsor"),
        "delta": lambda: F.col("value") - F.col("prev_value"),
        "lag": lambda: F.col("prev_value"),
        "pct_change": lambda: relative_change(F.col("value"), F.col("prev_value")),
        "deltawinsor": lambda: F.col("winsor") - F.col("prev_winsor"),
        "lagwinsor": lambda: F.col("prev_winsor"),
        "pct_changewinsor": lambda: relative_change(F.col("winsor"), F.col("prev_winsor")),
    }
    return table.select("codecommune", *_GROUP, *[built[k]().alias(k) for k in kinds])


def augmented_long(
    features: DataFrame, kinds: Iterable[str], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Augmented features in long form, each kind under its own feature name."""
    kinds = list(kinds)
    if kinds == ["raw"]:
        return features.select("codecommune", *_GROUP, "value")
    return variants_long(augment(features, kinds, rows_per_task), kinds)


def variants_long(wide: DataFrame, kinds: Iterable[str]) -> DataFrame:
    """The columns of ``augment`` as rows, each kind under its own feature name."""
    variants = F.array(
        *[
            F.struct(
                F.concat("feature", F.lit(AUGMENTATION_SUFFIXES.get(k, ""))).alias("feature"),
                F.col(k).alias("value"),
            )
            for k in kinds
        ]
    )
    # the year stays outside, so that a filter on it reaches the files
    return wide.select("codecommune", "annee", F.inline(variants)).select("codecommune", *_GROUP, "value")


def augmented_catalog(catalog: DataFrame, kinds: Iterable[str]) -> DataFrame:
    """(feature, annee) of ``augmented_long`` from those of its input: every kind has every year."""
    names = [F.concat("feature", F.lit(AUGMENTATION_SUFFIXES.get(k, ""))) for k in kinds]
    return catalog.select(F.explode(F.array(*names)).alias("feature"), "annee")
