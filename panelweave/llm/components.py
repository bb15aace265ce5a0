"""Connected components by alternating large and small stars, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.storage import stage


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest id reachable, for every id that has a link to another.

    Each round hangs every node's larger neighbours, then its smaller ones, on
    the smallest, until the edges are stars.  Only minima are aggregated; a hot
    node is met again in a join whose sides are both stored tables, so that it
    can be split.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u > v").distinct()
    edges = stage(edges, "edges")
    before = _digest(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = stage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = stage(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        edges = stage(small.where("u > v").distinct(), "edges")
        after = _digest(edges)
        if after == before:
            break
        before = after
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(heads)
