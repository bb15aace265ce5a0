"""Helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lower-cased A-Z, digits, and bytes above 127 stay; everything else becomes a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
#: Lower-cased A-Z; the white space of ``[\x20\x09-\x0D]`` becomes a space, other bytes stay.
TOKEN_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256)
)

Batch = list[list]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column whose name may hold dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def column_of(array: pa.Array, as_bytes: bool) -> list:
    if as_bytes:
        array = array.cast(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary())
    return array.to_pylist()


def _kept() -> dict:
    import sys
    import types

    return sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__.setdefault("state", {})


def worker_state(owner: str, key: object, make: Callable[[], object]) -> object:
    """What ``make`` gave the first time it was asked for in this Python worker.

    For tables that are costly to build and only save work, such as caches.
    They are kept until another operator runs in the worker (see ``release``).
    """
    kept = _kept()
    if (owner, key) not in kept:
        kept[owner, key] = make()
    return kept[owner, key]


def release(operator: str) -> None:
    """Drop what workers keep for operators other than ``operator``, and give freed memory back.

    A worker outlives its task and may next serve any other one.
    """
    import ctypes

    for owner, key in [k for k in _kept() if k[0] != operator]:
        del _kept()[owner, key]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def append_columns(
    df: DataFrame,
    text: str,
    outputs: T.StructType,
    make: Callable[[], Callable[[list], Batch]],
    keep: Sequence[str] | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """``df`` with columns computed row by row from whole texts in Arrow batches.

    ``make`` runs once a task and returns a function from the batch's texts (as
    UTF-8 bytes, None for null) and its ``extra`` columns to the output columns.
    ``keep`` names the columns carried along (default: all).  An output takes
    the place of an input column of the same name.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in outputs.fieldNames()]
    fields = [df.schema[c] for c in kept]
    carried = F.struct(*[quoted(c) for c in kept]) if kept else F.struct(F.lit(1).alias("_"))
    packed = df.select(carried.alias("kept"), quoted(text).cast("binary").alias("text"), *[quoted(c).alias(f"x{i}") for i, c in enumerate(extra)])
    schema = T.StructType([packed.schema["kept"], *outputs.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in outputs.fields]
        release(make.__module__)
        function = None
        for batch in batches:
            function = function or make()
            for start in range(0, batch.num_rows, 256):  # bounded Python copies of the texts
                part = batch.slice(start, 256)
                values = function(*[column_of(part.column(i), False) for i in range(1, part.num_columns)])
                arrays = [pa.array(v, type=t) for v, t in zip(values, types)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["kept", *outputs.fieldNames()])
        function = None
        release(make.__module__)

    out = packed.mapInArrow(run, schema=schema)
    return out.select(
        *[F.col("kept").getField(f.name).alias(f.name) for f in fields],
        *[quoted(f.name) for f in outputs.fields],
    )
