"""Feature selection: relevance by mutual information, redundancy by VIF."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.fixed_values import MI_FEATURES, RANDOM_SEED, VIF_LIMIT
from panelweave.operators.columns import numeric_columns, quoted
from panelweave.operators.distribution import cumulate, impute_medians
from panelweave.operators.sampling import sample_capped
from panelweave.storage import ROWS_PER_TASK, stage

_EXACT = 1e-12


def equal_frequency_cuts(
    df: DataFrame, columns: list[str], bins: int, rows_per_task: int = ROWS_PER_TASK
) -> dict[str, list[float | None]]:
    """For each column the values above which bins 1, 2, ... begin.

    A value lies in bin floor(bins * rows below it / rows), so bin j begins
    above the largest value with fewer than j / bins of the rows below it.  One
    row per column reaches the driver.
    """
    long = df.select(*[F.col(quoted(c)).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "feature", "x"
    )
    counts = stage(long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("copies")), "value-copies")
    positions = cumulate(counts, ["feature"], "x", counts.count(), rows_per_task)
    before = [F.col("below") * bins < F.col("total") * j for j in range(1, bins)]
    ends = [F.max(F.when(few, F.col("x"))).alias(f"c{j}") for j, few in enumerate(before)]
    found = positions.groupBy("feature").agg(*ends).collect()
    return {r["feature"]: list(r)[1:] for r in found}


def _bin(value: Column, ends: Column) -> Column:
    """Bin number of a value; a missing one is below all others."""
    above = lambda end: F.coalesce(value > end, end.isNull() & value.isNotNull())
    return F.size(F.filter(ends, lambda end: F.coalesce(above(end), F.lit(False))))


def mutual_information(
    df: DataFrame, features: list[str], target: str, bins: int = 10, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """(feature, score): mutual information of equal-frequency bins, in nats.

    Over all rows, at any size: the ends of the bins come from counted values,
    binning is a map step, and the cells (at most ``bins`` squared a feature) are
    combined before they are exchanged.  Equal values share a bin.  The table is
    read twice; give a stored one.
    """
    cuts = equal_frequency_cuts(df, [*dict.fromkeys([*features, target])], bins, rows_per_task)
    y = _bin(F.col(quoted(target)).cast("double"), F.lit(cuts.get(target, [])).cast("array<double>"))
    long = df.select(
        y.alias("by"), *[F.col(quoted(c)).cast("double").alias(c) for c in features]
    ).unpivot(["by"], features, "feature", "x")
    ends = df.sparkSession.createDataFrame(list(cuts.items()), "feature string, ends array<double>")
    # a row per column
    binned = long.join(F.broadcast(ends), "feature").select("feature", "by", _bin(F.col("x"), F.col("ends")).alias("bx"))
    cells = binned.groupBy("feature", "bx", "by").agg(F.count(F.lit(1)).cast("double").alias("n"))

    def total(*keys: str):
        return F.sum("n").over(Window.partitionBy("feature", *keys))

    terms = cells.select(
        "feature",
        (F.col("n") / total() * F.log(F.col("n") * total() / (total("bx") * total("by")))).alias("t"),
    )
    return terms.groupBy("feature").agg(F.sum("t").alias("score"))


def top_k(scores: DataFrame, n: int, by: str = "score", name: str = "feature") -> DataFrame:
    return scores.orderBy(F.desc(by), F.asc(name)).limit(n)


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """k x k Pearson matrix from one distributed pass."""
    vectors = VectorAssembler(inputCols=columns, outputCol="_v").transform(
        df.select(*[F.col(quoted(c)).cast("double").alias(c) for c in columns])
    )
    return Correlation.corr(vectors, "_v").first()[0].toArray()


def variance_inflation(corr: np.ndarray) -> np.ndarray:
    """VIF of each column given the others; infinite if it is determined by them."""
    k = len(corr)
    vifs = np.ones(k)
    constant = np.isnan(corr).sum(axis=1) >= max(k - 1, 1)
    for j in range(k):
        if k == 1:
            break
        if constant[j]:
            vifs[j] = np.inf
            continue
        others = [i for i in range(k) if i != j and not constant[i]]
        if not others:
            continue
        shared = corr[others, j]
        weights = np.linalg.lstsq(corr[np.ix_(others, others)], shared, rcond=None)[0]
        r2 = float(shared @ weights)
        vifs[j] = 1.0 / (1.0 - r2) if r2 < 1.0 - _EXACT else np.inf
    return vifs


def prune_by_vif(
    corr: np.ndarray, columns: list[str], limit: float = VIF_LIMIT
) -> tuple[list[str], list[tuple[str, float]]]:
    """Drop the worst column until all are within the limit: (kept, dropped).

    ``columns`` are in order of preference; of equal VIFs the first goes.
    Works on the k x k matrix alone, so no data is read again.
    """
    kept, dropped = list(range(len(columns))), []
    while len(kept) > 1:
        vifs = variance_inflation(corr[np.ix_(kept, kept)])
        worst = int(np.argmax(vifs))
        if vifs[worst] <= limit:
            break
        dropped.append((columns[kept[worst]], float(vifs[worst])))
        kept.pop(worst)
    return [columns[i] for i in kept], dropped


def vif_prune(df: DataFrame, ordered: list[str], limit: float = VIF_LIMIT) -> list[str]:
    return prune_by_vif(correlation_matrix(df, ordered), ordered, limit)[0]


class FeatureSelector:
    """Keep the ``n_mi`` most informative numeric features, then prune by VIF."""

    def __init__(self, n_mi: int = MI_FEATURES, vif_limit: float = VIF_LIMIT, bins: int = 10):
        self.n_mi = n_mi
        self.vif_limit = vif_limit
        self.bins = bins
        self.selected_features: list[str] = []
        self.scores: DataFrame | None = None

    def fit(
        self,
        df: DataFrame,
        keys: list[str],
        target: str,
        max_rows: int | None = None,
        seed: int = RANDOM_SEED,
    ) -> FeatureSelector:
        """Over all rows, or over a random sample of ``max_rows`` if that is set."""
        features = [c for c in numeric_columns(df) if c not in {*keys, target}]
        filled = impute_medians(df.filter(F.col(quoted(target)).isNotNull()), features)
        if max_rows is not None:
            filled = sample_capped(filled, keys, max_rows, seed)
        return self.fit_filled(stage(filled.select(*[F.col(quoted(c)) for c in [*features, target]]), "selection"), features, target)

    def fit_filled(self, rows: DataFrame, features: list[str], target: str) -> FeatureSelector:
        """Over a stored table without missing values, which is read as it is."""
        best = top_k(mutual_information(rows, features, target, self.bins), self.n_mi).collect()
        self.scores = rows.sparkSession.createDataFrame(best, "feature string, score double")
        self.selected_features = vif_prune(rows, [r["feature"] for r in best], self.vif_limit)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(quoted(c)) for c in self.selected_features])
