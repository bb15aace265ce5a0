"""Row predicates that state what happens to NULL."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_in(value: Column, excluded: Iterable, keep_null: bool) -> Column:
    """Exclude listed values; NULL stays only when ``keep_null`` is set."""
    outside = ~value.isin(*excluded)
    return F.coalesce(outside, F.lit(True)) if keep_null else outside


def complete(columns: Iterable[str]) -> Column:
    """No listed column is NULL; unlike ``dropna`` this reaches the file scan."""
    return reduce(and_, (F.col("`" + c.replace("`", "``") + "`").isNotNull() for c in columns), F.lit(True))


def name_matches(name: Column, contains: str, lacks: str | None = None) -> Column:
    """Substring test used to choose input files."""
    wanted = name.contains(contains)
    return wanted & ~name.contains(lacks) if lacks else wanted
