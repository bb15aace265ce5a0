"""Near-duplicate documents: tensored minhash banding with verified links.

Two collections of ``halves`` half-bands, two minhashes each, are computed; a
table key combines half-band i of the first with half-band j of the second, so
halves^2 tables cost 4 * halves minhashes.  With 10, a pair of similarity 0.8
meets in some table with probability 0.9999.

Equal shingle sets are one node.  Half-bands that no other node shares are
dropped before pairs of them are formed.  Every group of a table is linked as a
star to its most central member (whose half-bands are the most common), each
spoke is confirmed on the full sets, and components are formed.  A group whose
members then still lie in several components is settled exactly: its nodes meet
again over the rarest shingles of their sets (a prefix that two sets of the
required similarity must share, with the bound that shingle positions put on
their intersection), and pairs of different components are confirmed.  No
group is capped; in the worst case (many sets just below the similarity that
share rare shingles) this last step forms pairs with the square of the group.

Defined cases: documents without words or text are linked with nothing; rows
that share a doc_id are one document, linked through each of its texts; a null doc_id has no
component and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import append_columns, quoted
from panelweave.llm.components import connected_components
from panelweave.llm.shingles import mixed, shingles, word_hashes
from panelweave.storage import stage

WIDTH = 4
PERCENT = 80
HALVES = 10
SKETCH = 1 << 20

_SIGNED = T.StructType([
    T.StructField("n", T.LongType()),
    T.StructField("k1", T.LongType()),
    T.StructField("k2", T.LongType()),
    T.StructField("halves", T.ArrayType(T.LongType())),
])
_SET = T.StructType([T.StructField("set", T.ArrayType(T.LongType()))])


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _set(text: bytes | None, width: int) -> np.ndarray:
    return np.unique(shingles(word_hashes(text), width))


def signatures(docs: DataFrame, text: str, keep: list[str], width: int, halves: int) -> DataFrame:
    """Set size, a 128-bit key of the set, and its 2 * ``halves`` half-band keys."""

    def make():
        rng = np.random.default_rng(7)
        a = rng.integers(0, 2**63, 4 * halves, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, 4 * halves, dtype=np.uint64)
        tag = mixed(np.arange(1, 2 * halves + 1, dtype=np.uint64))

        def sign(texts):
            ns, k1, k2, keys = [], [], [], []
            for t in texts:
                s = _set(t, width)
                ns.append(len(s))
                if not len(s):
                    k1.append(0), k2.append(0), keys.append([])
                    continue
                low = np.full(4 * halves, np.iinfo(np.uint64).max, np.uint64)
                for start in range(0, len(s), 4096):  # a bounded matrix
                    part = s[start : start + 4096]
                    low = np.minimum(low, (a[:, None] * part + b[:, None]).min(axis=1))
                k1.append(int(_signed(s.sum(dtype=np.uint64, keepdims=True))[0]))
                k2.append(int(_signed(mixed(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64, keepdims=True))[0]))
                keys.append(_signed(mixed(mixed(low[::2]) * np.uint64(3) + low[1::2] + tag)))
            return [ns, k1, k2, keys]

        return sign

    return append_columns(docs, text, _SIGNED, make, keep=keep)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose full sets reach the similarity; sets travel to their partners once a pair."""
    left = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    right = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    met = pairs.join(left, "b").join(right, "a")
    same = F.size(F.array_intersect("sa", "sb"))
    return met.where(same * 100 >= percent * (F.size("sa") + F.size("sb") - same)).select("a", "b").distinct()


def _shared_halves(nodes: DataFrame) -> DataFrame:
    """(node, half, of, weight): half-band keys that other nodes have too; ``of`` is the collection, 0 or 1."""
    split = nodes.select("node", F.posexplode("halves").alias("at", "half"), (F.size("halves") / 2).alias("m"))
    split = split.select("node", "half", (F.col("at") >= F.col("m")).cast("int").alias("of"))
    common = stage(split.groupBy("half").agg(F.count("*").alias("weight")).where("weight > 1"), "common")
    return split.join(common, "half")


def _tables(nodes: DataFrame) -> DataFrame:
    """(key, node, weight): the table keys that more than one node has."""
    shared = _shared_halves(nodes).groupBy("node").agg(
        F.collect_set(F.when(F.col("of") == 0, F.col("half"))).alias("first"),
        F.collect_set(F.when(F.col("of") == 1, F.col("half"))).alias("second"),
        F.sum("weight").alias("weight"),
    )
    keyed = shared.select("node", "weight", "second", F.explode("first").alias("x"))
    keyed = keyed.select("node", "weight", "x", F.explode("second").alias("y"))
    keyed = stage(keyed.select(F.xxhash64("x", "y").alias("key"), "node", "weight"), "tables")
    stars = keyed.groupBy("key").agg(F.count("*").alias("members"), F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("centre"))
    stars = stage(stars.where("members > 1").select("key", (-F.col("centre.minus")).alias("centre")), "stars")
    return keyed.select("key", "node").join(stars, "key")


def _rare_order(sets: DataFrame) -> np.ndarray:
    """Counts of shingles by a hash of fixed size; any counts give a valid order."""
    slots = SKETCH

    def count(batches):
        seen = np.zeros(slots, np.int64)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            seen += np.bincount((flat % np.uint64(slots)).astype(np.int64), minlength=slots)
        at = np.flatnonzero(seen)
        for start in range(0, len(at), 65536):
            part = at[start : start + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[part])], names=["slot", "n"])

    counted = sets.select("set").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(slots, np.int64)
    out[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    return out


def _residual_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different labels that may reach the similarity, by prefixes of rare shingles."""
    shipped = sets.sparkSession.sparkContext.broadcast(_rare_order(sets))  # SKETCH counters

    def postings(batches):
        order, slots = shipped.value, np.uint64(SKETCH)
        for batch in batches:
            for node, label, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = np.array(tokens.as_py(), np.int64)
                u = s.view(np.uint64)
                n = len(s)
                s = s[np.lexsort((u, order[(u % slots).astype(np.int64)]))]
                prefix = n - -(-n * percent // 100) + 1
                full = lambda v: pa.array(np.full(prefix, v, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s[:prefix]), full(node), full(label), full(n), pa.array(np.arange(prefix))],
                    names=["token", "node", "label", "n", "at"],
                )

    found = stage(sets.select("node", "label", "set").mapInArrow(postings, "token long, node long, label long, n long, at long"), "postings")
    # the least intersection is percent / (100 + percent) of both sizes; a partner has percent of the size at least
    groups = found.groupBy("token").agg(F.min("n").alias("least"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    groups = stage(groups.where("l0 < l1").select("token", "least"), "groups")
    partner = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    useful = stage(found.join(groups, "token").where((F.col("n") - F.col("at")) * (100 + percent) >= percent * (F.col("n") + partner)).drop("least"), "useful")
    a, b = (useful.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "label", "n", "at")]) for s in "ab")
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    enough = rest * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))
    pairs = a.join(b, "token").where((F.col("label_a") != F.col("label_b")) & (F.col("node_a") < F.col("node_b")) & enough)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, percent: int = PERCENT, halves: int = HALVES
) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of ``docs``."""
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    signed = stage(signatures(rows, "text", ["doc_id"], width, halves), "signatures")
    counted = signed.where("n > 0 and doc_id is not null")
    classes = stage(counted.groupBy("k1", "k2").agg(F.min("doc_id").alias("node")), "classes")
    nodes = counted.select(F.col("doc_id").alias("node"), "halves", "k1", "k2").join(classes, ["k1", "k2", "node"]).select("node", "halves")
    tables = stage(_tables(nodes), "stars")

    wanted = tables.select(F.col("node").alias("doc_id")).distinct()

    def make():
        return lambda texts: [[_signed(_set(t, width)) for t in texts]]

    sets = append_columns(rows.join(wanted, "doc_id", "left_semi"), "text", _SET, make, keep=["doc_id"])
    sets = stage(sets.withColumnRenamed("doc_id", "node"), "sets")

    spokes = tables.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = stage(_verified(spokes, sets, percent), "links")
    # an id with several texts is one document, linked through each of them
    several = counted.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("x"), F.max(F.struct("k1", "k2")).alias("y")).where("x != y")
    texts = counted.join(several.select("doc_id"), "doc_id", "left_semi").join(classes, ["k1", "k2"])
    links = links.union(texts.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a != b").distinct())
    labels = stage(connected_components(links), "labels")
    labelled = tables.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    labelled = stage(labelled, "labelled")
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("c")).where("l0 < l1 and c > 2")
    unsettled = labelled.join(stage(open_keys.select("key"), "open"), "key").select("node", "label").distinct()
    unsettled = stage(unsettled, "unsettled")
    if unsettled.limit(1).count():
        residual = stage(sets.join(unsettled, "node"), "residual")
        more = _verified(stage(_residual_pairs(residual, percent), "pairs"), sets, percent)
        links = links.union(stage(more, "more"))
        labels = stage(connected_components(links), "labels")
    member = signed.join(classes, ["k1", "k2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node")
    )
    out = member.join(labels, "node", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "node", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, and those without an id."""
    found = near_duplicates(docs, text, doc_id, **options)
    gone = found.where("component_id != doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, quoted(doc_id).cast("long") == gone["gone"], "left_anti")
