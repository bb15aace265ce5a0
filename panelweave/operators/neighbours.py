"""Mutual information from the distance to the k-th nearest neighbour.

For a feature x and the target y, every row is a point of the plane, and its
radius is the distance to its k-th nearest other point, the larger of the two
differences counting.  With n_x and n_y the rows (the row itself included)
strictly within the radius on either axis, or equal if it is zero, the estimate is

    psi(n) + mean(psi(k) - psi(n_x) - psi(n_y)),  at least 0.

Where more than k rows are equal the radius is zero, and their number takes the
place of k, as in estimates for values that are partly discrete.

No table of pairs is made.  Points are cut into strips by x and strips into
cells by y, each of about as many points, so cells are small where points are
dense.  A point's neighbours in its own cell bound its radius; then it visits
only cells that reach into the square of that size.  Strips and their cells are
found by two joins whose tables have about the square root of all cells in a
row, in blocks of about the root of that with a box around each, cells are
searched in blocks of bounded size, and a cell with many visitors is split.  Rows on either axis are counted by their places in the order of all
values and range ends.

Values are brought to whole numbers first, in 2^-20 of the column's standard
deviation, so distances and counts are exact and repeat on any engine.  Equal
points are one with a number of copies, however many there are.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.numbers import nan_to_null
from panelweave.operators.columns import quoted
from panelweave.operators.distribution import cumulate
from panelweave.storage import ROWS_PER_TASK, pin_small, stage

NEIGHBOURS = 3
STEPS = 1 << 20
CELL_POINTS = 512
VISITORS = 4096
_EULER = 0.5772156649015329
_CELL = ["feature", "_strip", "_cell"]
_POINT = ["feature", "x", "y"]


def digamma(z: Column) -> Column:
    """Of positive whole numbers; a shift by six makes the series exact to 1e-10."""
    w = z + F.lit(6.0)
    series = F.log(w) - 1 / (2 * w) - 1 / (12 * w * w) + 1 / (120 * F.pow(w, 4)) - 1 / (252 * F.pow(w, 6))
    for i in range(6):
        series = series - 1 / (z + F.lit(float(i)))
    return series


def whole_points(df: DataFrame, features: list[str], target: str, steps: int = STEPS) -> DataFrame:
    """(feature, x, y, copies): distinct points of the rows that have both values."""
    columns = list(dict.fromkeys([*features, target]))
    clean = df.select(*[nan_to_null(F.col(quoted(c)).cast("double")).alias(c) for c in columns])
    facts = clean.agg(*[f(F.col(quoted(c))).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("low", F.min), ("std", F.stddev_pop))]).first()

    def whole(c: str) -> Column:
        low, std = facts[f"low{columns.index(c)}"], facts[f"std{columns.index(c)}"]
        if not std:  # constant or without values
            return F.when(F.col(quoted(c)).isNotNull(), F.lit(0).cast("long"))
        return F.floor((F.col(quoted(c)) - F.lit(low)) / F.lit(std) * F.lit(float(steps)))

    numbers = clean.select(whole(target).alias("_y"), *[whole(c).alias(c) for c in features])
    long = numbers.filter(F.col("_y").isNotNull()).unpivot(["_y"], [F.col(quoted(c)) for c in features], "feature", "x")
    points = long.filter(F.col("x").isNotNull()).groupBy("feature", "x", F.col("_y").alias("y"))
    return points.agg(F.count(F.lit(1)).alias("copies"))


def nearest_in_block(
    points: tuple[np.ndarray, np.ndarray], among: tuple[np.ndarray, np.ndarray], copies: np.ndarray, k: int, own: bool
) -> np.ndarray:
    """Points x k: ascending distances to their nearest ``among``, copies counted; -1 where there are fewer.

    ``own``: the points are those among which is searched, and none is its own neighbour.
    """
    apart = np.maximum(np.abs(points[0][:, None] - among[0]), np.abs(points[1][:, None] - among[1]))
    taken = min(k + own, apart.shape[1])
    at = np.argpartition(apart, taken - 1, axis=1)[:, :taken] if taken < apart.shape[1] else np.tile(np.arange(taken), (len(apart), 1))
    near = np.take_along_axis(apart, at, 1)
    order = np.argsort(near, axis=1, kind="stable")
    at, near = np.take_along_axis(at, order, 1), np.take_along_axis(near, order, 1)
    count = copies[at]
    if own:
        count = count - (at == np.arange(len(at))[:, None])
    upto = np.cumsum(count, axis=1)
    out = np.full((len(apart), k), -1, np.int64)
    for j in range(k):
        place = (upto <= j).sum(axis=1)
        there = place < taken
        out[there, j] = near[there, place[there]]
    return out


def _cells(points: DataFrame, cell_points: int) -> DataFrame:
    """Points with the strip and cell they lie in."""
    strips = max(1, ceil(sqrt(points.count() / cell_points)))
    cut = stage(points.repartitionByRange(strips, *_POINT).withColumn("_strip", F.spark_partition_id()), "strips")
    within = Window.partitionBy("feature", "_strip")
    nth = F.row_number().over(within.orderBy("y", "x")) - 1
    size = F.count(F.lit(1)).over(within)
    number = F.floor(nth * F.greatest(F.lit(1), F.floor(size / cell_points)) / size).cast("int")
    return stage(cut.withColumn("_cell", number), "cells")


def _lists(column: pa.ListArray, row: int, names: tuple[str, ...]) -> list[np.ndarray]:
    ends = column.offsets
    part = column.values.slice(ends[row].as_py(), ends[row + 1].as_py() - ends[row].as_py())
    return [part.field(n).to_numpy(zero_copy_only=False) for n in names]


def _near_rows(feature: str, x, y, copies, near: np.ndarray, below: np.ndarray | None = None) -> pa.RecordBatch:
    kept = near >= 0 if below is None else (near >= 0) & (near < below[:, None])
    ends = np.concatenate(([0], np.cumsum(kept.sum(axis=1)))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(near[kept]))
    columns = [pa.array([feature] * len(x)), pa.array(x), pa.array(y), pa.array(copies), lists]
    return pa.RecordBatch.from_arrays(columns, names=["feature", "x", "y", "copies", "near"])


_NEAR = "feature string, x long, y long, copies long, near array<long>"


def radii(points: DataFrame, k: int = NEIGHBOURS, cell_points: int = CELL_POINTS, visitors: int = VISITORS) -> DataFrame:
    """(feature, x, y, copies, radius): distance of each distinct point to its k-th neighbour.

    Points of a feature with k rows or fewer have no radius and are left out.
    """
    celled = _cells(points, cell_points)
    members = F.collect_list(F.struct("x", "y", "copies")).alias("members")  # at most twice cell_points
    box = [f(c).alias(f"{c}{i}") for c in ("x", "y") for i, f in enumerate((F.min, F.max))]
    packed = stage(celled.groupBy(*_CELL).agg(members, *box), "packed")

    def own(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                x, y, copies = _lists(batch.column(3), row, ("x", "y", "copies"))
                near = nearest_in_block((x, y), (x, y), copies, k, True)
                found = _near_rows(batch.column(0)[row].as_py(), x, y, copies, near)
                places = [pa.array(np.full(len(x), batch.column(i)[row].as_py(), np.int32)) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([*found.columns, *places], names=[*found.schema.names, "_strip", "_cell"])

    met = stage(packed.select(*_CELL, "members").mapInArrow(own, f"{_NEAR}, _strip int, _cell int"), "own")
    boxes = packed.drop("members")
    whole = boxes.groupBy("feature").agg(F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0")).alias("_widest"))
    corners = ["x0", "x1", "y0", "y1"]
    around = [(F.min if c[1] == "0" else F.max)(c).alias(c) for c in corners]
    cells = max(1, boxes.count())
    in_block = ceil(cells**0.25)  # the root of a strip's cells, and of the strips

    def blocks(df: DataFrame, by: list[str], number: str, out: str) -> DataFrame:
        """A row for ``by`` with the boxes in blocks, each with the box around it: a point meets few of them."""
        block = df.groupBy(*by, F.floor(F.col(number) / in_block).alias("_block")).agg(F.collect_list(F.struct(number, *corners)).alias("boxes"), *around)
        return block.groupBy(*by).agg(F.collect_list(F.struct("boxes", *corners)).alias(out), *around)

    of_strip = stage(blocks(boxes, ["feature", "_strip"], "_cell", "_cells"), "strip_boxes")
    of_feature = blocks(of_strip.select("feature", "_strip", *corners), ["feature"], "_strip", "_strips").select("feature", "_strips")
    facts = pin_small(of_feature.join(whole, "feature"))  # a row a feature

    # a neighbour in another cell counts only if it is nearer than the bound
    bound = F.coalesce(F.get("near", F.lit(k - 1)), F.col("_widest") + 1)

    def reaches(b: Column) -> Column:
        # of one box, or of a block, which a point reaches that reaches a box in it
        return (b.x0 - F.col("bound") < F.col("x")) & (F.col("x") < b.x1 + F.col("bound")) & (b.y0 - F.col("bound") < F.col("y")) & (F.col("y") < b.y1 + F.col("bound"))

    def reached(name: str) -> Column:
        return F.explode(F.flatten(F.transform(F.filter(name, reaches), lambda b: F.filter(b.boxes, reaches)))).alias("_to")

    asking = met.join(facts, "feature").withColumn("bound", bound)
    asking = asking.select(*_POINT, "copies", "bound", F.col("_strip").alias("_s"), F.col("_cell").alias("_c"), reached("_strips"))
    asking = asking.withColumn("_strip", F.col("_to._strip")).drop("_to").join(of_strip.select("feature", "_strip", "_cells"), ["feature", "_strip"])
    visits = asking.select(*_POINT, "copies", "bound", "_strip", "_s", "_c", reached("_cells"))
    visits = visits.withColumn("_cell", F.col("_to._cell")).filter((F.col("_strip") != F.col("_s")) | (F.col("_cell") != F.col("_c")))
    visits = stage(visits.select(*_CELL, "x", "y", "copies", "bound"), "visits")
    pieces = visits.groupBy(*_CELL).agg(F.ceil(F.count(F.lit(1)) / visitors).alias("_pieces"))
    spread = visits.join(pieces, _CELL).withColumn("_piece", F.pmod(F.xxhash64("x", "y"), F.col("_pieces")))
    guests = spread.groupBy(*_CELL, "_piece").agg(F.collect_list(F.struct("x", "y", "copies", "bound")).alias("guests"))
    blocks = guests.join(packed.select(*_CELL, "members"), _CELL).select("feature", "guests", "members")

    def visited(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                x, y, copies, bound = _lists(batch.column(1), row, ("x", "y", "copies", "bound"))
                among = _lists(batch.column(2), row, ("x", "y", "copies"))
                for start in range(0, len(x), 1024):
                    part = slice(start, start + 1024)
                    near = nearest_in_block((x[part], y[part]), (among[0], among[1]), among[2], k, False)
                    yield _near_rows(batch.column(0)[row].as_py(), x[part], y[part], copies[part], near, bound[part])

    lists = met.select(*_POINT, "copies", "near").unionByName(blocks.mapInArrow(visited, _NEAR))
    ordered = Window.partitionBy(*_POINT).orderBy("radius")
    nth = lists.select(*_POINT, "copies", F.explode("near").alias("radius")).withColumn("_nth", F.row_number().over(ordered))
    return nth.filter(F.col("_nth") == k).drop("_nth")


def _rows_within(points: DataFrame, axis: str, out: str, total: int, rows_per_task: int) -> DataFrame:
    """Add the number of rows whose value on the axis is less than the radius away, or equal."""
    reach = F.greatest(F.col("radius") - 1, F.lit(0))
    ends = points.withColumn("_lo", F.col(axis) - reach).withColumn("_hi", F.col(axis) + reach)
    values = ends.select("feature", F.col(axis).alias("v"), "copies")
    for end in ("_lo", "_hi"):
        values = values.unionAll(ends.select("feature", F.col(end).alias("v"), F.lit(0).cast("long").alias("copies")))
    counts = values.groupBy("feature", "v").agg(F.sum("copies").alias("copies"))
    places = stage(cumulate(counts, ["feature"], "v", 3 * total, rows_per_task), "places")
    upto = places.select("feature", F.col("v").alias("_hi"), (F.col("below") + F.col("copies")).alias("_upto"))
    under = places.select("feature", F.col("v").alias("_lo"), F.col("below").alias("_under"))
    found = ends.join(upto, ["feature", "_hi"]).join(under, ["feature", "_lo"])
    return found.withColumn(out, F.col("_upto") - F.col("_under")).drop("_lo", "_hi", "_upto", "_under")


def neighbour_information(
    df: DataFrame,
    features: list[str],
    target: str,
    k: int = NEIGHBOURS,
    steps: int = STEPS,
    cell_points: int = CELL_POINTS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """(feature, score): the estimate above in nats, over all rows that have both values.

    A feature with k such rows or fewer scores 0.  The table is read twice; give
    a stored one.
    """
    points = stage(whole_points(df, features, target, steps), "points")
    measured = stage(radii(points, k, cell_points), "radii")
    total = measured.count()
    for axis, out in (("x", "n_x"), ("y", "n_y")):
        measured = stage(_rows_within(measured, axis, out, total, rows_per_task), "counted")
    near = F.when(F.col("radius") > 0, F.lit(k).cast("long")).otherwise(F.col("copies"))
    terms = F.sum(F.col("copies") * (digamma(near) - digamma(F.col("n_x")) - digamma(F.col("n_y"))))
    rows = F.sum("copies")
    score = digamma(rows) + terms / rows
    scores = measured.groupBy("feature").agg(F.greatest(score, F.lit(0.0)).alias("score"))
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")  # a row a column
    return names.join(scores, "feature", "left").select("feature", F.coalesce("score", F.lit(0.0)).alias("score"))
