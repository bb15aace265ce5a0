"""Hand-kept label tables in CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.predicates import complete
from panelweave.operators.labels import last_wins


def read_csv_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; blank lines are skipped, empty fields are NULL."""
    return spark.read.option("header", True).option("escape", '"').csv(path)


def scan_lookup_csv(
    spark: SparkSession, path: str, key: str | list[str] = "Nuance", value: str = "Tendance", every: bool = False
) -> DataFrame:
    """(key, value) with one row per key, the last line of the file winning.

    A key may be several columns, such as code and label.  Lines follow each
    other by file name, place of the block in the file and place in the block.
    With ``every``, all lines that have a key are returned.
    """
    keys = [key] if isinstance(key, str) else key
    if every:
        return read_csv_table(spark, path).select(*keys, value).filter(complete(keys))
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return last_wins(read_csv_table(spark, path).select(*keys, value, place.alias("_line")), keys, value, "_line")
