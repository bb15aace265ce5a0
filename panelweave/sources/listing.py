"""Parquet datasets under a folder, from the file listing alone."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet_datasets(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, name, folder) of every Parquet dataset below ``root``.

    A folder whose name ends in ``.parquet``, as Spark writes it, is one
    dataset; any other Parquet file is one by itself.  ``folder`` is the path
    between ``root`` and the dataset.
    """
    return _named(_listed(spark, root), root).select("dataset", "name", "folder").distinct()


def dataset_versions(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, name, folder, version): the version follows from path, size and time of every file.

    A row a dataset, and sums over its files; no file is opened.
    """
    files = F.xxhash64("path", "length", F.col("modificationTime").cast("long"), F.unix_micros("modificationTime"))
    sums = F.concat_ws("-", F.count(F.lit(1)).cast("string"), F.sum("length").cast("string"), F.sum(files.cast("decimal(38,0)")).cast("string"))
    return _named(_listed(spark, root), root).groupBy("dataset", "name", "folder").agg(sums.alias("version"))


def _listed(spark: SparkSession, root: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet").load(root).select("path", "length", "modificationTime")
    )


def _named(listed: DataFrame, root: str) -> DataFrame:
    # the listing shows full paths with a scheme, whatever form the root has
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).strip("/")
    start = F.instr(F.col("path"), f"/{base}/") + F.lit(len(base) + 1)
    below = F.substring("path", start, F.length("path"))
    # shortest leading part that ends in .parquet
    inner = F.regexp_extract(below, r"^(.*?[^/]\.parquet)(/.*)?$", 1)
    outer = F.substring("path", F.lit(1), F.length("path") - F.length(below))
    return listed.select(
        "*",
        F.concat(outer, inner).alias("dataset"),
        F.substring_index(inner, "/", -1).alias("name"),
        F.regexp_extract(inner, r"^/?(.*?)/?[^/]*$", 1).alias("folder"),
    )
