"""As-of choice of a feature's year for a target year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.fixed_values import MAX_PAST_YEARS
from panelweave.storage import pin_small


def resolve_years(
    catalog: DataFrame, targets: DataFrame, max_past: int = MAX_PAST_YEARS
) -> DataFrame:
    """(feature, target, annee): the newest year <= target within ``max_past``.

    ``catalog`` has (feature, annee), ``targets`` has (target).  Each catalog
    year offers itself to the few target years it may serve, which makes the
    as-of condition an equality join between two metadata tables.
    """
    offers = catalog.select(
        "feature",
        "annee",
        F.explode(F.sequence(F.col("annee"), F.col("annee") + F.lit(max_past))).alias("target"),
    )
    chosen = offers.join(targets.select("target").distinct(), "target").groupBy("feature", "target")
    return pin_small(chosen.agg(F.max("annee").alias("annee")))


def asof_backfill(features: DataFrame, resolved: DataFrame) -> DataFrame:
    """Feature rows re-dated to the target year their catalog year serves.

    The years in use are few; naming them lets the scan skip all others.
    """
    used = [r[0] for r in resolved.select("annee").distinct().collect()]
    return features.filter(F.col("annee").isin(*used)).join(resolved, ["feature", "annee"]).select(
        "codecommune", "feature", F.col("target").alias("annee"), "value"
    )


def backfill_map(resolved: DataFrame) -> DataFrame:
    """Which target columns were filled from which older columns."""
    return resolved.filter(F.col("annee") < F.col("target")).select(
        "target",
        F.concat("feature", F.col("target").cast("string")).alias("filled"),
        F.concat("feature", F.col("annee").cast("string")).alias("source"),
    )
