"""Row and column filters driven by missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.fixed_values import MISSING_RATE_LIMIT


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def present(df: DataFrame, name: str) -> Column:
    """Whether a value is there; NaN of a float column is not."""
    value = F.col(quoted(name))
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return value.isNotNull() & ~F.isnan(value)
    return value.isNotNull()


def missing_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Row count and missing values per column, from one map-side aggregate."""
    counted = [F.count_if(present(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *counted).first()
    return row["n"], {c: row["n"] - row[f"c{i}"] for i, c in enumerate(df.columns)}


def missing_profile(df: DataFrame) -> DataFrame:
    """(column, missing, rate), one row per column."""
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(~present(df, c)).alias("missing"),
            F.try_divide(F.count_if(~present(df, c)).cast("double"), F.count(F.lit(1))).alias("rate"),
        )
        for c in df.columns
    ]
    return df.agg(F.array(*entries).alias("profile")).select(F.inline("profile"))


def drop_sparse(
    df: DataFrame, max_missing: float = 0.5, strict: bool = True
) -> tuple[DataFrame, list[str]]:
    """Drop columns with too many missing values; report which ones.

    ``strict`` drops a column whose missing share exceeds ``max_missing`` by row
    count; otherwise the test is made on the missing rate.  In both cases a
    column exactly at the limit stays.
    """
    rows, missing = missing_counts(df)

    def too_sparse(name: str) -> bool:
        if strict:
            return missing[name] > rows * max_missing
        return rows == 0 or missing[name] / rows > max_missing

    dropped = [c for c in df.columns if too_sparse(c)]
    return df.select(*[quoted(c) for c in df.columns if c not in set(dropped)]), dropped


def prepare(
    df: DataFrame, threshold: float = MISSING_RATE_LIMIT, election_type: int = 0
) -> DataFrame:
    """Rows of one election type, columns whose missing rate is within the limit."""
    kept, _ = drop_sparse(df.filter(F.col("type") == election_type), threshold, strict=False)
    return kept


def dropna_with_counts(
    df: DataFrame, columns: list[str], by: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Drop rows missing any of ``columns``; count drops at the first one missing.

    The counts equal those of dropping column after column, yet need one pass.
    They are given per value of ``by`` if set.
    """
    entries = []
    whole = F.lit(True)
    for position, name in enumerate(columns):
        fails = whole & ~present(df, name)
        entries.append(
            F.struct(
                F.lit(position).alias("step"),
                F.lit(name).alias("column"),
                F.count_if(fails).alias("dropped"),
            )
        )
        whole = whole & present(df, name)
    keys = [quoted(c) for c in by or []]
    counts = df.groupBy(*keys).agg(F.array(*entries).alias("steps"))
    return df.filter(whole), counts.select(*keys, F.inline("steps"))


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns, from the schema alone."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
