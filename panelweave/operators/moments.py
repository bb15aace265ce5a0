"""Linear models from sums of products, a fold at a time.

One pass gives, for every fold, the sums of products of (1, features, target).
A training set is the total less its fold, so every fold and every point of a
grid of penalties is a small solve on the driver; rows are not read again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.columns import quoted

_BATCH = 8192


def products_by_fold(df: DataFrame, features: list[str], target: str, fold: str) -> dict[int, np.ndarray]:
    """Fold -> matrix of the sums of products of (1, features, target), shifted by some row's values.

    The shift is the same for all folds and keeps large means from swallowing
    the spread.  What reaches the driver is (features + 2) squared numbers a fold.
    """
    columns = [*features, target]
    picked = df.select(F.col(quoted(fold)).cast("int").alias("fold"), *[F.col(quoted(c)).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    some = picked.drop("fold").first()
    shift = np.array([v if v is not None and np.isfinite(v) else 0.0 for v in some]) if some else np.zeros(len(columns))
    size = len(columns) + 1

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, _BATCH):
                part = batch.slice(start, _BATCH)
                folds = part.column(0).to_numpy(zero_copy_only=False)
                z = np.ones((part.num_rows, size))
                for i in range(1, size):
                    z[:, i] = part.column(i).to_numpy(zero_copy_only=False) - shift[i - 1]
                for f in np.unique(folds):
                    own = z[folds == f]
                    sums[int(f)] = sums.get(int(f), 0) + own.T @ own
        for f, matrix in sums.items():
            cells = pa.array(np.arange(size * size, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size * size, f, np.int32)), cells, pa.array(matrix.ravel())], names=["fold", "cell", "v"])

    found = picked.mapInArrow(run, "fold int, cell int, v double").groupBy("fold", "cell").agg(F.sum("v").alias("v")).collect()
    out: dict[int, np.ndarray] = {}
    for r in found:
        out.setdefault(r["fold"], np.zeros(size * size))[r["cell"]] = r["v"]
    return {f: m.reshape(size, size) for f, m in sorted(out.items())}


def ridge(products: np.ndarray, penalty: float, standardise: bool = True) -> np.ndarray:
    """Weights w with the prediction error w . (1, features, target): intercept, coefficients and -1.

    The penalty acts on coefficients of features divided by their standard
    deviation, or on the plain ones, as in Spark's own linear regression.
    """
    n = products[0, 0]
    mean = products[0, 1:] / n
    second = products[1:, 1:] / n
    centred = second - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(centred), 0))
    used = np.flatnonzero(spread[:-1] > 1e-12 * np.sqrt(np.maximum(np.diag(second)[:-1], 1e-300)))
    weights = np.zeros(len(products))
    weights[-1] = -1
    if spread[-1] > 0 and len(used):
        scale = spread[used]
        a = centred[np.ix_(used, used)] / np.outer(scale, scale)
        b = centred[used, -1] / (scale * spread[-1])
        cost = np.full(len(used), penalty / spread[-1])
        if not standardise:
            cost = cost / scale**2
        weights[1 + used] = np.linalg.lstsq(a + np.diag(cost), b, rcond=None)[0] * spread[-1] / scale
    weights[0] = mean[-1] - weights[1:-1] @ mean[:-1]
    return weights


def rows_of_equal_products(products: np.ndarray) -> np.ndarray:
    """2 x (features + 1) rows of (features, target) with the means and covariances of the rows behind ``products``.

    A least-squares fit reads nothing else of its rows, so it has the same path
    and result on these.  A column without spread keeps none.
    """
    n = products[0, 0]
    mean, second = products[0, 1:] / n, products[1:, 1:] / n
    centred = second - np.outer(mean, mean)
    flat = np.diag(centred) <= 1e-24 * np.maximum(np.diag(second), 1e-300)
    centred[flat, :], centred[:, flat] = 0, 0
    values, directions = np.linalg.eigh(centred)
    steps = (directions * np.sqrt(np.maximum(values, 0) * len(values))).T
    steps[:, flat] = 0
    return mean + np.concatenate((steps, -steps))


def score(products: np.ndarray, weights: np.ndarray, scoring: str) -> float:
    """Of the rows whose products these are; larger is better."""
    n = products[0, 0]
    squares = max(float(weights @ products @ weights), 0.0)
    if scoring == "neg_mean_squared_error":
        return -squares / n
    if scoring == "neg_root_mean_squared_error":
        return -((squares / n) ** 0.5)
    spread = products[-1, -1] - products[0, -1] ** 2 / n
    if spread <= 0:
        return 1.0 if squares == 0 else 0.0
    return 1.0 - squares / spread


def fold_scores(products: dict[int, np.ndarray], penalty: float, scoring: str, standardise: bool = True) -> list[float]:
    """The score of each fold by a model of all the others."""
    total = sum(products.values())
    return [float(score(own, ridge(total - own, penalty, standardise), scoring)) for own in products.values()]
