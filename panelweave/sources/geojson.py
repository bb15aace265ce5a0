"""Boundary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.functions.geometry import geometry_polygons, polygon_centroid
from panelweave.storage import pin_small, stage

_NESTED = 8  # lists inside lists within an object, at most; coordinates have four
_FEATURE = "type string, geometry struct<type string, coordinates string>, properties struct<code string>"
# the members of the document before its array of features, as far as they lie in one piece
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_VALUE = rf'(?:{_STRING}|[^\s"\[\]{{}},]++|\[(?:[^{{}}"\[\]]++|{_STRING}|\[[^{{}}"]*+\])*+\])'
_ARRAY = rf'^[\s,\]]*+\{{?(?:\s*+{_STRING}\s*+:\s*+{_VALUE}\s*+,)*+\s*+"features"\s*+:\s*+\['


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, nth, text): the files cut behind every closing brace.

    The cut is that of a text with this line end, so Spark splits a file of any
    size by byte ranges; a piece is never longer than a feature.
    """
    read = spark.read.option("lineSep", "}").text(path)
    return read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("nth"), F.col("value").alias("text"),
    )


def _running(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over the earlier pieces of the file.

    Within a split by a window, over splits from their totals, a row a split.
    """
    order = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("file", "split").agg(F.sum(value).alias("_sum"))
    shifts = totals.select("file", "split", F.coalesce(F.sum("_sum").over(order), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("file", "split").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(pin_small(shifts), ["file", "split"])
    return joined.withColumn(out, F.col("_shift") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_shift")


def scan_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(position, codecommune, polygons) of each feature of a FeatureCollection.

    ``path`` may name several files, and one file may be of any size: its byte
    ranges are read side by side.  Whether a range begins inside a string, how
    deep it lies and how many features ended before it follow from sums over
    the ranges before it; pieces of a feature that lies across ranges are put
    together.  ``position`` is the file and the place in it, and orders features.
    """
    pieces = stage(_pieces(spark, path), "pieces")
    # a piece ends at a brace, so an escape never lies across two
    bare = F.regexp_replace("text", r"\\.", "")
    quotes = stage(pieces.select("file", "split", "nth", _count(bare, '"').alias("quotes")), "quotes")
    started = _running(quotes, "quotes", "before").select("file", "split", "nth", (F.col("before") % 2 == 1).alias("inside"), ((F.col("before") + F.col("quotes")) % 2 == 1).alias("still"))
    marked = pieces.join(started, ["file", "split", "nth"])
    outside = F.regexp_replace(F.concat(F.when(F.col("inside"), F.lit('"')).otherwise(F.lit("")), bare), r'"[^"]*("|$)', "")
    brackets = F.regexp_replace(outside, r"[^\[\]{]", "")
    for _ in range(_NESTED):  # pairs go; what is left closes first and opens then
        brackets = F.regexp_replace(brackets, r"\[\]", "")
    shut = F.length(F.regexp_extract(brackets, r"^\]*", 0))
    change = F.length(brackets) - 2 * _count(brackets, "]") - F.when(F.col("still"), 0).otherwise(1)
    depths = stage(marked.select("file", "split", "nth", "text", "inside", "still", shut.alias("shut"), change.cast("long").alias("change")), "depths")
    placed = _running(depths, "change", "depth").withColumn("ends", F.col("depth") + F.col("change"))
    # something at depth 2 begins in the piece; features are the objects of one such thing, the array of that name
    opens = (F.col("depth") - F.col("shut") < 2) & (F.col("ends") >= 2)
    plain = F.when(F.col("inside"), F.regexp_replace("text", r'^(?:[^"\\]++|\\.)*+"', "")).otherwise(F.col("text"))
    placed = stage(placed.withColumn("opens", opens.cast("long")).withColumn("named", opens & plain.rlike(_ARRAY)).withColumn("plain", F.when(opens, plain)), "placed")
    within = _running(placed, "opens", "before").withColumn("at", F.col("before") + F.col("opens")).drop("before")
    arrays = pin_small(within.filter("named").select("file", "at"))  # a row a file
    inner = stage(within.join(arrays, ["file", "at"]), "inner")
    # the last brace of an object of the array leads back to depth 2
    closes = ~F.col("still") & (F.col("ends") == 2)
    counted = _running(inner.withColumn("closes", closes.cast("long")), "closes", "index")
    own = F.when(F.col("named"), F.regexp_replace("plain", _ARRAY, "")).otherwise(F.col("text"))
    left = (F.col("depth") - F.col("shut") < 2) & ~F.col("named")  # the array ends in this piece
    parts = counted.filter(~left).select("file", "index", F.struct("split", "nth", F.concat(own, F.lit("}")).alias("text")).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p.text), "")  # the pieces of a feature
    texts = parts.groupBy("file", "index").agg(joined.alias("text"))
    features = texts.select("file", "index", F.from_json(F.regexp_replace("text", r"^[\s,]+", ""), _FEATURE).alias("f"))
    known = features.filter(F.coalesce(F.col("f.type"), F.lit("Feature")) == "Feature")
    return known.select(
        F.struct("file", "index").alias("position"),
        F.col("f.properties.code").alias("codecommune"),
        geometry_polygons(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("polygons"),
    )


def scan_centroids(spark: SparkSession, path: str) -> DataFrame:
    """(position, codecommune, centroid_x, centroid_y) of each feature."""
    center = polygon_centroid(F.col("polygons"))
    return (
        scan_geojson(spark, path)
        .select("position", "codecommune", center.alias("c"))
        .select("position", "codecommune", F.col("c.x").alias("centroid_x"), F.col("c.y").alias("centroid_y"))
    )
