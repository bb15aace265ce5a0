"""Area centroids of GeoJSON rings with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SUMS = "struct<a double, x double, y double>"
_WALK = "struct<a double, x double, y double, px double, py double>"
_RING = "array<array<double>>"
_POLYGON = f"array<{_RING}>"
_MULTIPOLYGON = f"array<{_POLYGON}>"


def geometry_polygons(kind: Column, coordinates_json: Column) -> Column:
    """Coordinates of a Polygon or MultiPolygon as a list of ring lists."""
    return F.when(
        kind == "Polygon", F.array(F.from_json(coordinates_json, _POLYGON))
    ).when(kind == "MultiPolygon", F.from_json(coordinates_json, _MULTIPOLYGON))


def _zero() -> Column:
    return F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).cast(_SUMS)


def _add(left: Column, right: Column, sign: Column) -> Column:
    return F.struct(
        (left["a"] + sign * right["a"]).alias("a"),
        (left["x"] + sign * right["x"]).alias("x"),
        (left["y"] + sign * right["y"]).alias("y"),
    )


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _ring_sums(ring: Column, origin: Column) -> Column:
    """Twice the area and the first moments of a ring, always with positive area.

    Coordinates are taken relative to ``origin``: the cross products then stay
    small and keep their digits.  A walk over the points carries the point
    before; the first one meets itself, which adds nothing.
    """

    def edge(sums: Column, q: Column) -> Column:
        px, py, qx, qy = sums["px"], sums["py"], q["x"], q["y"]
        cross = px * qy - qx * py
        return F.struct(
            (sums["a"] + cross).alias("a"),
            (sums["x"] + (px + qx) * cross).alias("x"),
            (sums["y"] + (py + qy) * cross).alias("y"),
            qx.alias("px"),
            qy.alias("py"),
        )

    def walk(points: Column) -> Column:
        first = F.get(points, F.lit(0))
        zero = [F.lit(0.0).alias(c) for c in ("a", "x", "y")]
        start = F.struct(*zero, first["x"].alias("px"), first["y"].alias("py")).cast(_WALK)
        signed = F.aggregate(points, start, edge)
        return _bound(signed, lambda s: _add(_zero(), s, F.signum(s["a"])))

    near = F.transform(ring, lambda p: F.struct((p[0] - origin[0]).alias("x"), (p[1] - origin[1]).alias("y")))
    return F.when(F.size(ring) > 1, _bound(near, walk)).otherwise(_zero())


def polygon_centroid(polygons: Column) -> Column:
    """struct(x, y) of the area centroid; holes count negatively.

    The first ring of each polygon is its outline, further rings are holes.
    NULL when the total area is zero.
    """

    def of_shape(shape: Column) -> Column:
        first = F.lit(0)
        return _bound(F.get(F.get(F.get(shape, first), first), first), lambda origin: around(shape, origin))

    def around(shape: Column, origin: Column) -> Column:
        def polygon(total: Column, rings: Column) -> Column:
            holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
            outline = _bound(_ring_sums(F.element_at(rings, 1), origin), lambda ring: _add(total, ring, F.lit(1.0)))
            return F.aggregate(
                holes, outline,
                lambda acc, hole: _bound(_ring_sums(hole, origin), lambda ring: _add(acc, ring, F.lit(-1.0))),
            )

        return F.aggregate(shape, _zero(), polygon, lambda total: finish(total, origin))

    def finish(total: Column, origin: Column) -> Column:
        return F.when(
            total["a"] != 0,
            F.struct(
                (origin[0] + total["x"] / (total["a"] * 3)).alias("x"),
                (origin[1] + total["y"] / (total["a"] * 3)).alias("y"),
            ),
        )

    return _bound(polygons, of_shape)
