"""Exact top-k search: tiled products, partial selection, tree merge.

Vectors are quantised to floor(scale * x).  Queries travel in blocks of a fixed
size; each task multiplies a block with tiles of its shard, keeps the best k
per query after every tile by partial selection, and returns one list per
query.  Lists of tasks are merged in a tree of fixed fan-in.

Defined cases: null vectors and vectors holding null or non-finite components
take no part; vectors of unequal length are padded with zeros; an empty vector
scores 0; candidates are all rows with another id than the query's; repeated
rows each count; of query rows that share an id the smallest vector asks;
ties go to the smaller id; a null id takes no part; scores beyond 64 bits are
held at the limits.  Products are exact: tiles whose sums could pass 2^53 are
computed in whole numbers.
"""

from __future__ import annotations

from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import quoted

QUERY_BLOCK = 2048
TILE_CELLS = 4_000_000
FAN_IN = 8
_LONG = 2**63


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part."""
    x = quoted(embedding)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        vectors.select(quoted(vec_id).cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    )


def _matrix(vectors: pa.Array, scale: float) -> np.ndarray:
    lengths = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if len(lengths) and (lengths == width).all():
        out = flat.reshape(len(lengths), width)
    else:
        out = np.zeros((len(lengths), width))
        out[np.arange(width) < lengths[:, None]] = flat
    with np.errstate(over="ignore"):
        scaled = np.floor(out * scale)
    if np.isfinite(scaled).all():
        return scaled
    factor = Fraction(scale)  # beyond the largest double: Python's whole numbers
    return np.array([floor(Fraction(x) * factor) for x in out.ravel().tolist()], dtype=object).reshape(out.shape)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = max(a.shape[1], b.shape[1], 1)
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    if a.dtype != object and b.dtype != object:
        with np.errstate(over="ignore"):
            bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * width
        if bound < 2**53:
            return a @ b.T
    whole = [np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -_LONG, _LONG - 1).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query: high scores first, then small ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= least)  # all ties of the last place
        ids, scores = ids[among], scores[among]
    order = np.lexsort((ids, ~scores))[:k]  # ~s sorts as -s and cannot overflow
    return ids[order], scores[order]


def _search_shard(batches, queries, scale: float, k: int):
    query_ids, query_matrix = queries
    best_ids = [np.empty(0, np.int64)] * len(query_ids)
    best = [np.empty(0, np.int64)] * len(query_ids)
    least = np.full(len(query_ids), -_LONG, np.int64)
    rows = max(1, TILE_CELLS // max(1, len(query_ids)))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            tile = batch.slice(start, rows)
            ids = tile.column(0).to_numpy(zero_copy_only=False)
            scores = _scores(query_matrix, _matrix(tile.column(1), scale)).astype(np.int64)
            for q in np.flatnonzero(scores.max(axis=1, initial=-_LONG) >= least):
                line, own = scores[q], ids != query_ids[q]
                if len(best[q]) == k:  # only what can still enter
                    own &= line >= best[q][-1]
                at = np.flatnonzero(own)
                if len(at):
                    best_ids[q], best[q] = _best(np.concatenate((best_ids[q], ids[at])), np.concatenate((best[q], line[at])), k)
                    if len(best[q]) == k:
                        least[q] = best[q][-1]
    yield pa.RecordBatch.from_arrays(
        [pa.array(query_ids), pa.array(best_ids, pa.list_(pa.int64())), pa.array(best, pa.list_(pa.int64()))],
        names=["query_id", "ids", "scores"],
    )


def top_k(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    scale: float = 1024.0,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` for every query row.

    Work is queries times vectors, in blocks; a block of queries is broadcast,
    ``query_block`` rows at most.
    """
    spark = vectors.sparkSession
    asked = usable(queries, vec_id, embedding).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    among = usable(vectors, vec_id, embedding)
    shards = among.rdd.getNumPartitions()
    total = asked.count()
    blocks = -(-total // query_block) or 1
    lists = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        ids = part.column("vec_id").to_numpy()
        vecs = part.column("embedding").combine_chunks() if part.num_rows else pa.array([], pa.list_(pa.float64()))
        shipped = spark.sparkContext.broadcast((ids, _matrix(vecs, scale)))

        def search(batches, shipped=shipped):
            yield from _search_shard(batches, shipped.value, scale, k)

        found = among.mapInArrow(search, "query_id long, ids array<long>, scores array<long>")
        found = found.withColumn("part", F.spark_partition_id())
        lists = found if lists is None else lists.unionByName(found)
    width = shards * blocks
    while True:  # a tree of merges; each joins FAN_IN lists at most
        width = -(-width // FAN_IN)
        pairs = F.flatten(F.collect_list(F.arrays_zip("scores", "ids")))
        merged = lists.groupBy("query_id", F.floor(F.col("part") / FAN_IN).cast("int").alias("part")).agg(pairs.alias("pairs"))
        first = F.slice(
            F.array_sort("pairs", lambda a, b: F.when(a.scores > b.scores, -1).when(a.scores < b.scores, 1).when(a.ids < b.ids, -1).when(a.ids > b.ids, 1).otherwise(0)),
            1, k,
        )
        lists = merged.select("query_id", "part", F.transform(first, lambda p: p.ids).alias("ids"), F.transform(first, lambda p: p.scores).alias("scores"))
        if width <= 1:
            break
    out = lists.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))
