"""All registered queries, each next to the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL if there is one."""

    def register(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = with_views(sql.strip())
        return function

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six decimals, as in the SQL, so that summation order cannot show."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def load() -> None:
    """Import the modules that fill the registry."""
    from checks import (  # noqa: F401
        queries_assembly,
        queries_joins,
        queries_models,
        queries_periods,
        queries_rows,
    )
