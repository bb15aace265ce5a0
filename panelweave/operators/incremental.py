"""Augmented features kept on disk and brought up to date group by group.

A group is a feature in a year.  Its ranks and bounds depend on the group
alone and its changes on the catalog year before it, so what a new, changed or
vanished year touches is that group and the next catalog year of the feature;
to compute these, the raw rows of the year before each are needed as well.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.functions.predicates import complete
from panelweave.operators.augment import augment
from panelweave.sources.cache import stored_table
from panelweave.storage import ROWS_PER_TASK, pin_small, stage

_GROUP = ["feature", "annee"]


@dataclass(frozen=True)
class Augmented:
    """The table, and the groups (feature, annee) that this call computed."""

    rows: DataFrame
    computed: DataFrame


def group_digests(features: DataFrame) -> DataFrame:
    """(feature, annee, n, d0, d1): tells whether a group's rows changed, whatever their order."""
    rows = features.filter(complete(_GROUP))
    sides = [F.bit_xor(F.xxhash64(F.lit(i), "codecommune", "value")).alias(f"d{i}") for i in (0, 1)]
    return rows.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"), *sides)


def affected_groups(now: DataFrame, before: DataFrame) -> DataFrame:
    """(feature, annee, target, source): groups to compute anew, and groups whose raw rows that takes.

    ``now`` and ``before`` are ``group_digests``.  One window over the catalog
    of groups; a target that is gone is no source.
    """
    old = before.select(*_GROUP, F.struct("n", "d0", "d1").alias("_old"))
    both = now.select(*_GROUP, F.struct("n", "d0", "d1").alias("_new")).join(old, _GROUP, "full_outer")
    by_year = Window.partitionBy("feature").orderBy("annee")
    past, earlier = by_year.rowsBetween(Window.unboundedPreceding, 0), by_year.rowsBetween(Window.unboundedPreceding, -1)
    here = F.col("_new").isNotNull()
    looked = both.select(*_GROUP, here.alias("_here"), (~F.col("_new").eqNullSafe(F.col("_old"))).alias("_changed")).select(
        "*",
        F.max(F.when(F.col("_changed"), F.col("annee"))).over(past).alias("_last_changed"),
        F.max(F.when(F.col("_here"), F.col("annee"))).over(earlier).alias("_year_before"),
    )
    follows = F.col("_here") & F.coalesce(F.col("_last_changed") >= F.col("_year_before"), F.col("_last_changed").isNotNull())
    targets = looked.withColumn("target", F.col("_changed") | follows)
    # the next group that is here: gone ones are skipped
    later = by_year.rowsBetween(1, Window.unboundedFollowing)
    next_is_target = F.first(F.when(F.col("_here"), F.col("target")), ignorenulls=True).over(later)
    source = F.col("_here") & (F.col("target") | F.coalesce(next_is_target, F.lit(False)))
    return targets.withColumn("source", source).filter("target or source").select(*_GROUP, "target", "source")


def refreshed_augmentation(
    spark: SparkSession, folder: str, key: str, features: DataFrame, kinds: Iterable[str], rows_per_task: int = ROWS_PER_TASK
) -> Augmented:
    """``augment`` of ``features``, stored under ``key`` and computed only where groups changed.

    ``features`` is the whole raw table.  Counting and digesting its groups is
    one scan combined on the map side; the exchanges of ranks and previous
    values see the rows of changed groups, of the groups before and after them,
    and no others.  A year of the stored table with changed groups is written
    anew as a version of its own; which version of each year counts is written
    last, so a broken run leaves the former table.  Rows without feature or
    year are in no group and are left out.  Years that are no longer current
    stay on disk until the folder is deleted; one writer at a time.
    """
    kinds = list(kinds)
    base = f"{folder.rstrip('/')}/{key}-{hashlib.md5(repr(kinds).encode()).hexdigest()[:8]}"
    version = f"v{uuid.uuid4().hex[:12]}"  # a letter first: never read as a number
    current = stored_table(spark, f"{base}/current")
    known = None if current is None else current.first()
    group_digests(features).write.parquet(f"{base}/digests-{version}")
    now = spark.read.parquet(f"{base}/digests-{version}")
    before = now.limit(0) if known is None else spark.read.parquet(f"{base}/digests-{known[0]}")
    groups = stage(affected_groups(now, before), "groups")
    targets, sources = (pin_small(groups.filter(c).select(*_GROUP)) for c in ("target", "source"))
    years = {} if known is None else {r["annee"]: r["version"] for r in spark.read.parquet(f"{base}/years-{known[0]}").collect()}  # a row a year
    touched = sorted(r[0] for r in groups.filter("target").select("annee").distinct().collect())
    if touched or known is None:
        raw = features.join(sources, _GROUP, "left_semi")
        rows = augment(raw, kinds, rows_per_task).join(targets, _GROUP, "left_semi")
        stale = {y: v for y, v in years.items() if y in touched}
        if stale:
            kept = _versions(spark, f"{base}/rows", stale).drop("version").join(targets, _GROUP, "left_anti")
            rows = rows.unionByName(kept)
        # rebalance: few files for a year, and large years split over tasks
        spread = rows.withColumn("version", F.lit(version)).hint("rebalance", "annee")
        spread.write.mode("append").partitionBy("version", "annee").parquet(f"{base}/rows")
        years.update(dict.fromkeys(touched, version))
        spark.createDataFrame(sorted(years.items()), "annee int, version string").coalesce(1).write.parquet(f"{base}/years-{version}")
        spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{base}/current")
    result = augment(features.limit(0), kinds, rows_per_task) if not years else _versions(spark, f"{base}/rows", years)
    columns = ["codecommune", *_GROUP, *kinds]
    return Augmented(result.select(*columns), groups.filter("target").select(*_GROUP))


def _versions(spark: SparkSession, path: str, years: dict[int, str]) -> DataFrame:
    """The rows of these years in these versions; other folders are not listed as input."""
    chosen = [(F.col("version") == v) & F.col("annee").isin([y for y in years if years[y] == v]) for v in sorted(set(years.values()))]
    return spark.read.parquet(path).filter(reduce(or_, chosen))
