"""Centroid clustering in whole numbers by Orchard's search.

Each centroid has a list of the others, nearest first.  A vector starts at some
centroid and walks its list; as soon as a centroid is nearer than the current
one (or as near with a smaller number) the walk goes on in that one's list, past
those already visited.  It ends at a neighbour whose distance from the current
centroid is more than twice the vector's: by the triangle inequality neither
that one nor those behind it can be as near.

Vectors are turned into floor(scale * x).  Assignments, sums and centroids are
exact: batches whose numbers are too large for machine words are computed in
Python's whole numbers.

Defined cases: a vector that is null, has another number of components than
``width``, or holds a null or non-finite one takes no part, nor does a null id;
repeated rows each count, and of rows that share an id each is a vector of its
own; with fewer vectors than centroids there are as many centroids as vectors;
equal distances go to the smaller number; a centroid without vectors stays; an
empty table gives an empty result; distances and inertia beyond 64 bits are held
at the limit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import quoted
from panelweave.storage import stage

K = 40
ROUNDS = 5
WIDTH = 64
SCALE = 256
GUESS = 8
_BATCH = 4096
_LIMIT = 2**63 - 1


def usable(vectors: DataFrame, vec_id: str, embedding: str, width: int) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part."""
    x = quoted(embedding)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    found = vectors.select(quoted(vec_id).cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"), bad.alias("bad"))
    return found.where(F.col("vec_id").isNotNull() & (F.size("embedding") == width) & ~F.col("bad")).drop("bad")


def _small(width: int) -> int:
    """Components below this: four times a squared distance fits a machine word."""
    return isqrt(2**58 // max(width, 1))


def whole_numbers(flat: np.ndarray, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) by rows: machine words, or Python's numbers where those are too short."""
    if np.abs(flat).max(initial=0) < _small(width) / scale:
        return np.floor(flat * scale).astype(np.int64).reshape(-1, width)
    exact = [(n * scale) // d for n, d in (float(x).as_integer_ratio() for x in flat)]
    return np.array(exact, dtype=object).reshape(-1, width)


class Centroids:
    """Centroids with their sorted neighbour lists."""

    def __init__(self, rows: list[list[int]]) -> None:
        self.rows = rows
        self.exact = np.array(rows, dtype=object)
        small = all(abs(x) < _small(len(row)) for row in rows for x in row)
        self.words = np.array(rows, np.int64) if small else None
        apart = ((self.exact[:, None, :] - self.exact[None, :, :]) ** 2).sum(axis=2)
        numbers = range(len(rows))
        self.lists = np.array([sorted((j for j in numbers if j != i), key=lambda j: (apart[i, j], j)) for i in numbers], np.int64).reshape(len(rows), -1)
        self.apart = np.array([[apart[i, j] for j in self.lists[i]] for i in numbers], dtype=object).reshape(len(rows), -1)

    def nearest(self, x: np.ndarray, guess: int = GUESS) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's centroid, by Orchard's search for all rows side by side."""
        words = self.words is not None and x.dtype != object
        centres = self.words if words else self.exact
        apart = self.apart.astype(np.int64) if words else self.apart
        x = x if words else x.astype(object)
        n, k = len(x), len(centres)

        def distance(rows, to):
            gap = x[rows] - centres[to]
            return (gap * gap).sum(axis=1)

        # any start gives the same result; the leading components give a near one
        lead = np.stack([((x[:, :guess] - c[:guess]) ** 2).sum(axis=1) for c in centres], axis=1)
        now = lead.argmin(axis=1) if words else np.array([int(min(range(k), key=lambda j: row[j])) for row in lead], np.int64)
        best = distance(np.arange(n), now)
        seen = np.zeros((n, k), bool)
        seen[np.arange(n), now] = True
        place, active = np.zeros(n, np.int64), np.arange(n) if k > 1 else np.empty(0, np.int64)
        while len(active):
            at, spot = now[active], place[active]
            going = (apart[at, spot] <= 4 * best[active]).astype(bool)  # ends strictly beyond twice the distance
            active, at, spot = active[going], at[going], spot[going]
            other = self.lists[at, spot]
            place[active] += 1
            fresh = ~seen[active, other]
            rows, to = active[fresh], other[fresh]
            seen[rows, to] = True
            found = distance(rows, to)
            nearer = ((found < best[rows]) | ((found == best[rows]) & (to < now[rows]))).astype(bool)
            moved = rows[nearer]
            now[moved], best[moved], place[moved] = to[nearer], found[nearer], 0
            active = active[place[active] < k - 1]
        return now, best


def _batches(batches, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, _BATCH):
            part = batch.slice(start, _BATCH)
            if part.num_rows:
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                yield part.column(0).to_numpy(), whole_numbers(flat, len(flat) // part.num_rows, scale)


_SUMS = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])


def _next(vectors: DataFrame, centroids: Centroids, scale: int) -> list[list[int]]:
    """The centroids of the next round.

    A task sends a row a cluster with its sums; those of a cluster are added up
    in slices, then over the slices, so neither step grows beyond tasks.
    """
    shipped = vectors.sparkSession.sparkContext.broadcast(centroids)  # k rows
    schema = "cluster int, n long, sums array<string>"

    def run(batches):
        centroids, sums, counts = shipped.value, {}, {}
        for ids, x in _batches(batches, scale):
            clusters, _ = centroids.nearest(x)
            for c in np.unique(clusters):
                own = x[clusters == c]
                add = own.sum(axis=0)  # a batch of words of 28 bits fits a word
                sums[c] = add.astype(object) + sums.get(c, 0)
                counts[c] = counts.get(c, 0) + len(own)
        rows = [{"cluster": int(c), "n": counts[c], "sums": [str(v) for v in sums[c]]} for c in sums]
        yield pa.RecordBatch.from_pylist(rows, schema=_SUMS)

    def added(table: pa.Table) -> pa.Table:
        total = [sum(map(int, column)) for column in zip(*table.column("sums").to_pylist())]
        row = {"cluster": table.column("cluster")[0].as_py(), "n": sum(table.column("n").to_pylist()), "sums": [str(v) for v in total]}
        return pa.Table.from_pylist([row], schema=_SUMS)

    by_task = vectors.mapInArrow(run, schema).withColumn("slice", F.spark_partition_id() % 64)
    partial = by_task.groupBy("cluster", "slice").applyInArrow(added, schema)
    found = partial.groupBy("cluster").applyInArrow(added, schema).collect()  # a row a cluster
    rows = [list(row) for row in centroids.rows]
    for r in found:
        rows[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]
    return rows


def centroid_digest(row: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, salt: str = "2:") -> Centroids | None:
    """Centroids after ``rounds`` rounds over a table of (vec_id, embedding); None without vectors."""
    drawn = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(drawn, "embedding").limit(k).collect()  # k rows
    if not first:
        return None
    rows = [[int(v) for v in whole_numbers(np.array(r["embedding"]), len(r["embedding"]), scale)[0]] for r in first]
    for _ in range(rounds):
        rows = _next(vectors, Centroids(rows), scale)
    return Centroids(rows)


def assign(vectors: DataFrame, centroids: Centroids, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance of every vector; distances as whole numbers in text."""
    shipped = vectors.sparkSession.sparkContext.broadcast(centroids)  # k rows

    def run(batches):
        for ids, x in _batches(batches, scale):
            clusters, distances = shipped.value.nearest(x)
            held = [min(int(d), _LIMIT) for d in distances]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(clusters.astype(np.int32)), pa.array(held, pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(
    vectors: DataFrame,
    k: int = K,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row for each vector."""
    spark = vectors.sparkSession
    kept = stage(usable(vectors, vec_id, embedding, width), "vectors")
    centroids = fit(kept, k, rounds, scale)
    if centroids is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    assigned = stage(assign(kept, centroids, scale), "assigned")
    wide = F.sum(F.col("distance").cast("decimal(19,0)"))
    by_cluster = [(r["cluster"], int(r["d"])) for r in assigned.groupBy("cluster").agg(wide.alias("d")).collect()]  # a row a cluster
    inertia = min(sum(d for _, d in by_cluster), _LIMIT)
    facts = [(c, min(d, _LIMIT), inertia, centroid_digest(centroids.rows[c])) for c, d in by_cluster]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
