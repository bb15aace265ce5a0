"""Ballot rows -> vote shares of political blocs per commune and year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.fixed_values import (
    BALLOT_COLUMNS,
    BLOC_SHARE_COLUMNS,
    EUROPEAN_TYPE_CODE,
    NON_EUROPEAN_ELECTIONS,
)
from panelweave.functions.names import commune_code, election_year
from panelweave.functions.numbers import ratio_or_zero, row_total, share_or_zero
from panelweave.functions.predicates import not_in
from panelweave.operators.aggregates import pivot_sum, sum_by
from panelweave.operators.columns import quoted
from panelweave.operators.labels import lookup
from panelweave.sources.lookups import scan_lookup_csv
from panelweave.sources.parquet import scan_projected

SHARES = list(BLOC_SHARE_COLUMNS.values())


def bloc_votes(labelled: DataFrame) -> DataFrame:
    """Votes per bloc and commune-year, wide, from labelled ballot rows."""
    return pivot_sum(labelled, ["annee", "codecommune"], "tendance", BLOC_SHARE_COLUMNS, "voix")


def bloc_shares(votes: DataFrame) -> DataFrame:
    """Each bloc's part of the votes of all blocs, 0 when there are none."""
    total = F.col("exprimes")
    return votes.withColumn("exprimes", row_total(SHARES)).withColumns(
        {c: share_or_zero(F.col(c), total) for c in SHARES}
    )


def with_turnout(shares: DataFrame, registered: DataFrame) -> DataFrame:
    """Replace the vote total by its ratio to the registered voters."""
    joined = shares.join(registered, ["annee", "codecommune"], "left")
    return joined.withColumn(
        "pvoteppar", ratio_or_zero(F.col("exprimes"), F.col("inscrits"))
    ).drop("exprimes")


def bloc_panel(
    ballots: DataFrame,
    registered: DataFrame,
    maps: list[DataFrame],
    type_code: int = EUROPEAN_TYPE_CODE,
    on: str | list[str] = "nuance",
) -> DataFrame:
    """Shares of five blocs, turnout and registered voters per commune-year.

    ``ballots``: (annee, codecommune, nuance, voix).  ``registered``: (annee,
    codecommune, inscrits).  ``maps``: (nuance, tendance), unique, in order of
    precedence; ``on`` names their key, which may be several columns of the
    ballots.  Both details are combined on the map side and hashed on
    (annee, codecommune) once; the join reuses that partitioning.
    """
    labelled = lookup(ballots, maps, on, "tendance", "tendance")
    shares = bloc_shares(bloc_votes(labelled))
    voters = sum_by(registered, ["annee", "codecommune"], ["inscrits"])
    panel = with_turnout(shares, voters)
    return panel.select(
        "codecommune", "annee", *SHARES, "pvoteppar", "inscrits", F.lit(type_code).alias("type")
    )


def european_panel(
    spark: SparkSession,
    ballots_path: str,
    registered_path: str,
    map_paths: list[str],
    filter_registered: bool = True,
    type_code: int = EUROPEAN_TYPE_CODE,
    label_key: tuple[str, ...] = ("Nuance",),
) -> DataFrame:
    """The bloc panel of European elections from the published files.

    ``filter_registered=False`` sums registered voters over every election of a
    year instead of the European ones.  ``label_key`` names the columns, of the
    ballots and of every lookup file, that decide a list's bloc.
    """
    european = not_in(F.col("id_election"), NON_EUROPEAN_ELECTIONS, keep_null=False)
    code = commune_code(F.col("`Code du département`"), F.col("`Code de la commune`"))
    ballots = scan_projected(spark, ballots_path, list(BALLOT_COLUMNS), predicate=european).select(
        election_year(F.col("id_election")).alias("annee"),
        code.alias("codecommune"),
        *[F.col(quoted(k)) for k in label_key],
        F.col("Voix").alias("voix"),
    )
    registered = scan_projected(
        spark,
        registered_path,
        ["id_election", "Code du département", "Code de la commune", "Inscrits"],
        predicate=european if filter_registered else None,
    ).select(
        election_year(F.col("id_election")).alias("annee"),
        code.alias("codecommune"),
        F.col("Inscrits").alias("inscrits"),
    )
    maps = [
        scan_lookup_csv(spark, p, list(label_key)).withColumnRenamed("Tendance", "tendance")
        for p in map_paths
    ]
    return bloc_panel(ballots, registered, maps, type_code, list(label_key))
