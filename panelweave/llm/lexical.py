"""Ranked lexical search over an index stratified by document length.

A document's score depends on its length only through the normaliser m, so
documents of equal m form a stratum, in which what a term adds depends on its
count tf alone.  The index has a row for each block of a stratum: the block's
documents, and its postings ordered by (term, tf).  The impact of a (term, tf)
is worked out once for all postings of that run.

A block's bound for an item is the sum of the largest impacts of its terms.
Blocks are visited by falling bounds, and an item skips those whose bound is
below the last score of its list so far.  The blocks with the highest bounds of
each item are visited first, by all tasks together, so that every task starts
with thresholds that hold for the whole table.

All arithmetic is in whole numbers, except the logarithm in a term's weight.

Defined cases: a null or empty text, and one without terms, has no term and is
not counted; a null doc_id takes no part; rows that share a doc_id are each a
document; a null item_id is not searched; rows that share an item_id are one
item with the terms of all; items or documents without terms give no rows; very
long texts are read whole; equal scores go by ascending doc_id, and repeated
rows are each ranked.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import WORD_BYTES, append_columns, quoted
from panelweave.storage import stage

K = 50
#: Terms of items held and broadcast at once; more items are searched in several rounds.
TERMS_AT_ONCE = 1_000_000
BLOCK_DOCS = 2048
BLOCK_POSTINGS = 400_000
SHARD_POSTINGS = 2_000_000
#: Blocks with the highest bounds of an item that are visited before all others.
FIRST_VISITS = 3
_CELLS = 2_000_000

_TERMS = T.StructType([T.StructField("terms", T.ArrayType(T.StringType()))])
_COUNTED = T.StructType([
    T.StructField("n", T.LongType()),
    T.StructField("terms", T.ArrayType(T.IntegerType())),
    T.StructField("counts", T.ArrayType(T.IntegerType())),
])
_BLOCK = (
    "m long, block long, docs array<long>, terms array<int>, tfs array<int>, ends array<int>, places array<int>"
)


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item_id, term)."""

    def make():
        return lambda texts: [[sorted({w.decode("utf-8", "replace") for w in terms_of(t)}) for t in texts]]

    found = append_columns(items.where(quoted(item_id).isNotNull()), text, _TERMS, make, keep=[item_id])
    return found.select(quoted(item_id).alias("item_id"), F.explode("terms").alias("term")).distinct()


@dataclass
class Query:
    """Items by number; the terms of item i are ``terms[starts[i] : starts[i + 1]]``, numbers in the vocabulary."""

    items: list
    starts: np.ndarray
    terms: np.ndarray
    vocabulary: dict[bytes, int]


def _query(pairs: pa.Table) -> Query:
    rows = sorted(zip(pairs.column(0).to_pylist(), pairs.column(1).to_pylist()))
    vocabulary: dict[bytes, int] = {}
    items, starts, terms = [], [], []
    for item, term in rows:
        if not items or items[-1] != item:
            items.append(item), starts.append(len(terms))
        terms.append(vocabulary.setdefault(term.encode(), len(vocabulary)))
    return Query(items, np.array([*starts, len(terms)], np.int64), np.array(terms, np.int64), vocabulary)


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, number of terms, and counts of those in ``vocabulary``."""
    rows = docs.where(quoted(doc_id).isNotNull()).select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)  # TERMS_AT_ONCE at most

    def make():
        number = shipped.value.get

        def count(texts):
            ns, terms, counts = [], [], []
            for t in texts:
                words = terms_of(t)
                ns.append(len(words))
                found = [v for v in map(number, words) if v is not None]
                at, n = np.unique(np.array(found, np.int32), return_counts=True)
                terms.append(at), counts.append(n.astype(np.int32))
            return [ns, terms, counts]

        return count

    return append_columns(rows, "text", _COUNTED, make, keep=["doc_id"])


def _block(m: int, number: int, docs: list[np.ndarray], terms: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    """A row of the index: postings ordered by term, then tf, then document."""
    term, tf = np.concatenate(terms), np.concatenate(counts)
    place = np.repeat(np.arange(len(terms), dtype=np.int32), [len(t) for t in terms])
    order = np.lexsort((place, tf, term))
    term, tf, place = term[order], tf[order], place[order]
    last = np.flatnonzero((np.diff(term, append=-1) != 0) | (np.diff(tf, append=-1) != 0))
    columns = [np.array(docs, np.int64), term[last], tf[last], (last + 1).astype(np.int32), place]
    types = [pa.int64(), *[pa.int32()] * 4]
    arrays = [pa.array([m], pa.int64()), pa.array([number], pa.int64()), *[pa.array([c], pa.list_(t)) for c, t in zip(columns, types)]]
    return pa.RecordBatch.from_arrays(arrays, names=["m", "block", "docs", "terms", "tfs", "ends", "places"])


def build_index(counted: DataFrame, documents: int, terms: int, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Blocks of strata from ``count_terms``, over documents with a counted term.

    Partitioned by ranges of m and a hash of the id, so a stratum of any size is
    spread over as many tasks as it needs.
    """
    n = F.col("n").cast("decimal(19,0)")
    # 64-bit results of whole numbers whose products may be longer
    m = F.lit(50) + F.expr(f"(cast(n as decimal(19,0)) * cast({50 * documents} as decimal(19,0))) div cast({max(terms, 1)} as decimal(19,0))")
    holding = counted.where((n > 0) & (F.size("terms") > 0)).select(m.cast("long").alias("m"), "doc_id", "terms", "counts")
    postings = counted.agg(F.sum(F.greatest(F.size("terms"), F.lit(0)).cast("long"))).first()[0] or 0
    shards = -(-postings // SHARD_POSTINGS) or 1
    spread = F.xxhash64("doc_id")
    laid = holding.withColumn("h", spread).repartitionByRange(shards, "m", "h").sortWithinPartitions("m", "h").drop("h")
    laid = laid.withColumn("part", F.spark_partition_id())

    def run(batches):
        held, number, postings, before = ([], [], []), 0, 0, None
        for batch in batches:
            part = batch.column(4)[0].as_py() if batch.num_rows else 0
            ms, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            term_ends, flat_terms = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            count_ends, flat_counts = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy()
            for i in range(batch.num_rows):
                if held[0] and (ms[i] != before or len(held[0]) >= block_docs or postings >= BLOCK_POSTINGS):
                    yield _block(before, (part << 32) + number, *held)
                    held, number, postings = ([], [], []), number + 1, 0
                before = int(ms[i])
                held[0].append(ids[i])
                held[1].append(flat_terms[term_ends[i] : term_ends[i + 1]].copy())
                held[2].append(flat_counts[count_ends[i] : count_ends[i + 1]].copy())
                postings += len(held[1][-1])
        if held[0]:
            yield _block(before, (part << 32) + number, *held)

    return laid.mapInArrow(run, _BLOCK)


def _array(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    ends = column.offsets.to_numpy()
    return column.values.to_numpy()[ends[row] : ends[row + 1]]


def _ranges(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, number) of the numbers of all ranges [begin, end), one range after the other."""
    sizes = ends - begins
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


class Block:
    """A stratum's block with what each of its (term, tf) runs adds to a score."""

    def __init__(self, batch: pa.RecordBatch, row: int, weights: np.ndarray) -> None:
        m = batch.column(0)[row].as_py()
        self.number = batch.column(1)[row].as_py()
        self.docs = _array(batch, "docs", row)
        run_terms, tfs = _array(batch, "terms", row).astype(np.int64), _array(batch, "tfs", row).astype(np.int64)
        self.ends = _array(batch, "ends", row).astype(np.int64)
        self.places = _array(batch, "places", row)
        self.impacts = weights[run_terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m))
        self.firsts = np.flatnonzero(np.diff(run_terms, prepend=-1))  # runs at which a term begins
        self.terms = run_terms[self.firsts]

    def bounds(self, query: Query) -> np.ndarray:
        """No document here can score more, item by item.  The run of the largest tf is a term's last."""
        last = np.append(self.firsts[1:], len(self.impacts)) - 1
        most = np.zeros(len(query.vocabulary) + 1, np.int64)
        most[self.terms] = self.impacts[last]
        return np.add.reduceat(most[query.terms], query.starts[:-1])

    def scores(self, query: Query, asked: np.ndarray) -> np.ndarray:
        """Scores of all documents of the block for the items ``asked`` for."""
        at = np.full(len(query.vocabulary), -1, np.int64)
        at[self.terms] = np.arange(len(self.terms))
        per_posting = np.repeat(self.impacts, np.diff(self.ends, prepend=0))
        begins = np.append(np.concatenate(([0], self.ends))[self.firsts], self.ends[-1:])
        row, term = _ranges(query.starts[asked], query.starts[asked + 1])
        met = at[query.terms[term]]
        row, met = row[met >= 0], met[met >= 0]
        out = np.zeros((len(asked), len(self.docs)), np.int64)
        chunk = np.cumsum(begins[met + 1] - begins[met]) // _CELLS  # postings at a time
        for part in np.unique(chunk):
            now = chunk == part
            nth, posting = _ranges(begins[met[now]], begins[met[now] + 1])
            cell = row[now][nth] * out.shape[1] + self.places[posting]
            added = per_posting[posting]
            if int(added.max(initial=0)) * len(met) < 2**53:
                out += np.bincount(cell, weights=added, minlength=out.size).reshape(out.shape).astype(np.int64)
            else:
                np.add.at(out.ravel(), cell, added)
        return out

class Lists:
    """The best documents of each item so far, and the score that a further one has to reach."""

    def __init__(self, items: int, k: int, least: np.ndarray) -> None:
        self.k, self.least = k, least.copy()
        self.docs = [np.empty(0, np.int64)] * items
        self.scores = [np.empty(0, np.int64)] * items

    def visit(self, block: Block, query: Query, bounds: np.ndarray) -> None:
        asked = np.flatnonzero((bounds >= self.least) & (bounds > 0))
        step = max(1, _CELLS // max(1, len(block.docs)))
        for start in range(0, len(asked), step):
            some = asked[start : start + step]
            scores = block.scores(query, some)
            for nth in np.flatnonzero(scores.max(axis=1) >= self.least[some]):
                item, line = some[nth], scores[nth]
                at = np.flatnonzero(line >= self.least[item])
                docs, found = np.concatenate((self.docs[item], block.docs[at])), np.concatenate((self.scores[item], line[at]))
                if len(found) > 2 * self.k:
                    keep = np.flatnonzero(found >= np.partition(found, len(found) - self.k)[len(found) - self.k])
                    docs, found = docs[keep], found[keep]
                best = np.lexsort((docs, -found))[: self.k]
                self.docs[item], self.scores[item] = docs[best], found[best]
                if len(best) == self.k:
                    self.least[item] = max(self.least[item], self.scores[item][-1])

    def rows(self) -> pa.RecordBatch:
        sizes = [len(d) for d in self.docs]
        items = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        return pa.RecordBatch.from_arrays(
            [pa.array(items), pa.array(np.concatenate(self.docs)), pa.array(np.concatenate(self.scores))], names=["item", "doc_id", "score"]
        )


_HITS = "item int, doc_id long, score long"


def _visited(index: DataFrame, shipped, least: np.ndarray, k: int) -> DataFrame:
    """The best ``k`` of each task; documents below ``least`` of an item are left out."""

    def run(batches):
        query, weights = shipped.value
        lists = Lists(len(query.items), k, np.maximum(least, 1))
        for batch in batches:
            for start in range(0, batch.num_rows, 32):  # decoded together, visited by falling bounds
                blocks = [Block(batch, row, weights) for row in range(start, min(start + 32, batch.num_rows))]
                bounds = [b.bounds(query) for b in blocks]
                for at in sorted(range(len(blocks)), key=lambda i: -int(bounds[i].max(initial=0))):
                    lists.visit(blocks[at], query, bounds[at])
        yield lists.rows()

    return index.mapInArrow(run, _HITS)


def _first_blocks(index: DataFrame, shipped, visits: int) -> DataFrame:
    """The blocks with the highest bounds of each item: some for each task, then of all."""

    def run(batches):
        query, weights = shipped.value
        bounds = np.zeros((visits, len(query.items)), np.int64)  # the highest of each item so far
        numbers = np.zeros_like(bounds)
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row, weights)
                new = block.bounds(query)
                at = np.flatnonzero(new > bounds[-1])
                bounds[-1, at], numbers[-1, at] = new[at], block.number
                order = np.argsort(-bounds[:, at], axis=0, kind="stable")
                bounds[:, at], numbers[:, at] = np.take_along_axis(bounds[:, at], order, 0), np.take_along_axis(numbers[:, at], order, 0)
        items = np.tile(np.arange(bounds.shape[1], dtype=np.int32), visits)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (items, numbers.ravel(), bounds.ravel())], names=["item", "block", "bound"])

    found = index.mapInArrow(run, "item int, block long, bound long").where("bound > 0")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= visits).select("block").distinct()


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each item with their rank; first within slices of an item's rows."""
    best = [F.desc("score"), F.asc("doc_id")]
    sliced = hits.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    slices = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("item", "slice").orderBy(*best))).where(F.col("rank") <= k)
    order = Window.partitionBy("item").orderBy(*best)
    return slices.select("item", "doc_id", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def _search(docs: DataFrame, query: Query, k: int, text: str, doc_id: str, block_docs: int) -> DataFrame:
    spark = docs.sparkSession
    counted = stage(count_terms(docs, query.vocabulary, text, doc_id), "counted")
    documents, terms = counted.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    spread = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()  # the vocabulary at most
    df = dict(zip(spread.column("term").to_pylist(), spread.column("df").to_pylist()))
    weights = np.array([floor(1000 * log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(query.vocabulary))], np.int64)
    index = stage(build_index(counted, documents, int(terms or 0), block_docs), "index")
    shipped = spark.sparkContext.broadcast((query, weights))  # TERMS_AT_ONCE entries at most
    nothing = np.zeros(len(query.items), np.int64)
    first = stage(_first_blocks(index, shipped, FIRST_VISITS), "first")
    some = _ranked(_visited(index.join(first, "block", "left_semi").select(*index.columns), shipped, nothing, k), k)
    least = nothing.copy()
    for row in some.where(F.col("rank") == k).collect():  # a row an item
        least[row["item"]] = row["score"]
    ranked = _ranked(_visited(index, shipped, least, k), k)
    names = spark.createDataFrame(list(enumerate(query.items)), "item int, item_id " + _type_of(query.items))
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def _type_of(items: list) -> str:
    return "long" if items and isinstance(items[0], int) else "string"


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
    terms_at_once: int = TERMS_AT_ONCE,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item.

    Items are taken in rounds of ``terms_at_once`` terms; each round reads the
    documents once.
    """
    pairs = stage(item_terms(items, item_id, item_text), "item_terms")
    size = pairs.count()
    rounds, out = -(-size // terms_at_once) or 1, None
    kind = pairs.schema["item_id"].dataType
    for turn in range(rounds):
        mine = pairs if rounds == 1 else pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == turn)
        query = _query(mine.select("item_id", "term").toArrow())
        if query.items:
            found = _search(docs, query, k, text, doc_id, block_docs)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id string, rank int, doc_id long, score long").withColumn("item_id", F.col("item_id").cast(kind))
    return out.withColumn("item_id", F.col("item_id").cast(kind))
