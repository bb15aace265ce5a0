"""Expressions over identifiers: commune codes, election ids, feature names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: name patterns ---------------------------------------------
YEAR_AT_END = r"(\d{4})$"
YEAR_INSIDE = r"(\d{4})(?!$)"
ELECTION_LABEL = r"^(\d{4})([A-Za-z]*)-(.+)$"
VOTE_COLUMN = r"^pvote([A-Za-z_]*?)(\d{4})([A-Za-z]*)-(.+)$"


def commune_code(dept: Column, commune: Column) -> Column:
    """Department and commune codes glued together; NULL if either is NULL."""
    return F.concat(dept, commune)


def department(code: Column) -> Column:
    return F.substring(code, 1, 2)


def election_year(election_id: Column) -> Column:
    return F.substring(election_id, 1, 4).cast("int")


def _group(name: Column, pattern: str, index: int) -> Column:
    found = F.regexp_extract(name, pattern, index)
    return F.when(found != "", found)


def feature_year(name: Column) -> Column:
    """Four trailing digits as an int, NULL when the name carries no year."""
    return _group(name, YEAR_AT_END, 1).cast("int")


def feature_stem(name: Column) -> Column:
    return F.regexp_replace(name, YEAR_AT_END, "")


def move_year_to_end(name: Column) -> Column:
    """Give names such as ``pop1999h`` the trailing-year form ``poph1999``."""
    misplaced = name.rlike(YEAR_INSIDE) & ~name.rlike(YEAR_AT_END)
    moved = F.concat(F.regexp_replace(name, YEAR_INSIDE, ""), F.regexp_extract(name, YEAR_INSIDE, 1))
    return F.when(misplaced, moved).otherwise(name)


def with_default_year(name: Column, year: Column | int, not_features: tuple[str, ...]) -> Column:
    """Append a file-wide year to every column name that is a feature."""
    year = year if isinstance(year, Column) else F.lit(year)
    return F.when(name.isin(*not_features), name).otherwise(
        F.concat(name, F.lit("_"), year.cast("string"))
    )


def parse_election(label: Column) -> Column:
    """``2012-legislative`` -> struct(annee, round, election_type)."""
    return F.struct(
        _group(label, ELECTION_LABEL, 1).cast("int").alias("annee"),
        F.regexp_extract(label, ELECTION_LABEL, 2).alias("round"),
        _group(label, ELECTION_LABEL, 3).alias("election_type"),
    )


def parse_vote_column(name: Column) -> Column:
    """``pvoteG2012-legislative`` -> struct(var, annee, round, election_type)."""
    return F.struct(
        F.regexp_extract(name, VOTE_COLUMN, 1).alias("var"),
        _group(name, VOTE_COLUMN, 2).cast("int").alias("annee"),
        F.regexp_extract(name, VOTE_COLUMN, 3).alias("round"),
        _group(name, VOTE_COLUMN, 4).alias("election_type"),
    )
