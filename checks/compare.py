"""Run queries beside their SQL on DuckDB and compare the rows exactly.

    python -m checks.compare [/path/to/sf] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from glob import glob
from os.path import basename

from pyspark.sql import SparkSession

from checks import registry


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("panelweave")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for path in glob(f"{sf}/*.parquet"):
        con.execute(f"create view {basename(path)[:-8]} as select * from '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    return value


def as_rows(columns: list[str], table) -> Counter:
    order = sorted(columns)
    data = [table.column(columns.index(c)).to_pylist() for c in order]
    return Counter(tuple(_plain(v) for v in row) for row in zip(*data))


def compare(spark: SparkSession, con, sf: str, name: str) -> str | None:
    """None when equal, else what differs."""
    result = registry.QUERIES[name](spark, sf).toArrow()
    sql = registry.ORACLES.get(name)
    if sql is None:
        return None if result.num_rows else "no rows"
    expected = con.execute(sql).to_arrow_table()
    if sorted(result.column_names) != sorted(expected.column_names):
        return f"columns {sorted(result.column_names)} != {sorted(expected.column_names)}"
    types = {
        c: (str(result.schema.field(c).type), str(expected.schema.field(c).type))
        for c in result.column_names
    }
    loose = {"int32": "int", "int64": "int", "double": "double", "decimal128(38, 0)": "int"}
    clash = {c: t for c, t in types.items() if loose.get(t[0], t[0]) != loose.get(t[1], t[1])}
    got, want = as_rows(result.column_names, result), as_rows(expected.column_names, expected)
    if got != want:
        return f"{result.num_rows} / {expected.num_rows} rows; only here {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}; types {clash}"
    if clash:
        return f"values equal, types differ {clash}"
    return None


def main(argv: list[str]) -> int:
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    registry.load()
    spark, con, failed = session(), duck(sf), 0
    for name in argv[2:] or list(registry.QUERIES):
        start = time.time()
        try:
            problem = compare(spark, con, sf, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        mark = "ok  " if problem is None else "FAIL"
        kind = "" if name in registry.ORACLES else " (rows only)"
        print(f"{mark} {name}{kind} {time.time() - start:.1f}s {problem or ''}", flush=True)
        failed += problem is not None
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
