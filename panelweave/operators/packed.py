"""Panels with more columns than a table should have: packed rows.

A row holds its keys and its cells, (id, value) by ascending id; a dictionary
tells the label of each id.  Empty cells take no room, and neither the number
of labels nor that of rows reaches the driver.  The dictionary says which
labels there are: cells whose id it lacks are not read any more, so choosing
columns rewrites no row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.fixed_values import MAX_PAST_YEARS
from panelweave.functions.predicates import complete
from panelweave.operators.aggregates import only_value
from panelweave.operators.asof import resolve_years
from panelweave.operators.columns import quoted
from panelweave.operators.ordering import number_in_order
from panelweave.storage import pin_small, stage


@dataclass(frozen=True)
class PackedPanel:
    """``rows``: keys, further columns, ``cells``; ``labels``: (id, label)."""

    rows: DataFrame
    labels: DataFrame
    keys: tuple[str, ...]


def dictionary(labels: DataFrame, label: str) -> DataFrame:
    """(id, label) of the distinct non-NULL labels, numbered from 0 in their order."""
    found = labels.select(F.col(quoted(label)).alias("label")).filter("label is not null").distinct()
    return stage(number_in_order(found, ["label"], "id", start=0).select("id", "label"), "labels")


def _gather(cells: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Cells (keys, id, value) as packed rows; one exchange, on the keys.

    Two values for a cell are an error, found before a row is put together, so
    that a row never holds more than a value a label.
    """
    by = [F.col(quoted(k)) for k in keys]
    value = F.when(F.col("id").isNotNull(), only_value("value", what)).alias("value")
    unique = cells.repartition(*by).groupBy(*by, "id").agg(value)
    filled = F.when(complete(["id", "value"]), F.struct("id", "value"))
    return unique.groupBy(*by).agg(F.sort_array(F.collect_list(filled)).alias("cells"))


def pack(long: DataFrame, keys: list[str], label: str, value: str, labels: DataFrame | None = None) -> PackedPanel:
    """One packed row per key of a long table.

    The counterpart of ``widen`` for any number of labels, with its rules: rows
    with a NULL key meet in one row, two values for a cell are an error, rows
    without a label or with one that ``labels`` lacks only keep their key alive.
    NULL values are empty cells.  ``labels`` is a ``dictionary``; without it the
    labels of the rows are numbered.
    """
    labels = dictionary(long, label) if labels is None else labels
    cells = long.select(*[F.col(quoted(k)) for k in keys], F.col(quoted(label)).alias("label"), F.col(quoted(value)).cast("double").alias("value"))
    numbered = cells.join(pin_small(labels), "label", "left")
    return PackedPanel(_gather(numbered, keys, f"pack {value}"), labels, tuple(keys))


def unpack(panel: PackedPanel) -> DataFrame:
    """(columns of the rows, label, value), a row for each filled cell."""
    own = [F.col(quoted(c)) for c in panel.rows.columns if c != "cells"]
    cells = panel.rows.select(*own, F.inline("cells"))
    return cells.join(pin_small(panel.labels), "id").drop("id")


def with_columns(panel: PackedPanel, names: list[str]) -> DataFrame:
    """The rows with the chosen labels as columns in place of the cells.

    For the few columns a model takes.  A name the dictionary lacks is an error.
    No exchange: the chosen cells are cut out of each row first.
    """
    ids = {r["label"]: r["id"] for r in panel.labels.filter(F.col("label").isin(names)).collect()}  # a row a chosen name
    unknown = sorted(set(names) - set(ids))
    if unknown:
        raise ValueError(f"no such labels: {', '.join(unknown)}")
    own = [F.col(quoted(c)) for c in panel.rows.columns if c != "cells"]
    chosen = F.map_from_entries(F.filter("cells", lambda c: c["id"].isin(list(ids.values()))))
    return panel.rows.withColumn("cells", chosen).select(*own, *[F.try_element_at("cells", F.lit(ids[n])).alias(n) for n in names])


def missing_rates(panel: PackedPanel) -> DataFrame:
    """(id, label, filled, missing): filled cells and share of rows without one; NULL for no rows."""
    rows = panel.rows.count()
    filled = panel.rows.select(F.inline("cells")).groupBy("id").agg(F.count(F.lit(1)).alias("filled"))
    counted = panel.labels.join(filled, "id", "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    share = 1 - F.col("filled") / F.lit(rows) if rows else F.lit(None).cast("double")
    return counted.withColumn("missing", share)


def keep_by_missing(panel: PackedPanel, max_missing: float) -> PackedPanel:
    """Labels of which at most this share of the rows is missing."""
    kept = missing_rates(panel).filter(F.col("missing") <= max_missing)
    return replace(panel, labels=stage(kept.select("id", "label"), "labels"))


def as_of(panel: PackedPanel, year: str, targets: DataFrame, max_past: int = MAX_PAST_YEARS) -> PackedPanel:
    """Rows at the target years, each cell from the newest year its label has within ``max_past``.

    ``year`` is one of the keys and ``targets`` has (target).  A label serves a
    target by one year for all rows, as in ``resolve_years``.
    """
    others = [k for k in panel.keys if k != year]
    cells = panel.rows.select(*[F.col(quoted(k)) for k in panel.keys], F.inline("cells"))
    cells = cells.join(pin_small(panel.labels.select("id")), "id", "left_semi")
    catalog = cells.select(F.col("id").alias("feature"), F.col(quoted(year)).alias("annee")).distinct()
    resolved = resolve_years(stage(catalog, "catalog"), targets, max_past)
    served = resolved.select(F.col("feature").alias("id"), F.col("annee").alias("_from"), F.col("target").alias("_to"))
    dated = cells.withColumnRenamed(year, "_from").join(served, ["id", "_from"]).withColumnRenamed("_to", year)
    return replace(panel, rows=_gather(dated.select(*[F.col(quoted(k)) for k in [*others, year]], "id", "value"), list(panel.keys), "as of"))


def correlations(panel: PackedPanel, target: str) -> DataFrame:
    """(label, filled, correlation) of each label's cells with a column of the rows.

    Combined on the map side, one row a label: the measure by which a few of
    very many columns are chosen for ``with_columns``.  Cells of rows whose
    target is NULL or NaN do not count; a constant side gives NULL.
    """
    known = panel.rows.filter(F.col(quoted(target)).isNotNull() & ~F.isnan(F.col(quoted(target)).cast("double")))
    cells = known.select(F.col(quoted(target)).cast("double").alias("_target"), F.inline("cells"))
    moments = cells.groupBy("id").agg(F.count(F.lit(1)).alias("filled"), F.nanvl(F.corr("value", "_target"), F.lit(None).cast("double")).alias("correlation"))
    return panel.labels.join(moments, "id").select("label", "filled", "correlation")
