"""SimHash near-duplicates found by the general pigeonhole principle.

A fingerprint of 64 bits has bit b set if more than half of a text's shingle
hashes have it.  Two fingerprints link at ``within`` differing bits or fewer.

The bits are dealt to parts, correlated ones together.  If ``within + 1`` units
are shared out among the parts of a fingerprint, u units to a part, then a
fingerprint within reach agrees with it in some part to u - 1 bits or fewer (a
part with no unit is skipped).  How the units are shared is chosen for each
fingerprint by dynamic programming over the keys that have to be probed and the
candidates expected behind them; the expectation comes from histograms of the
whole table, of a size that does not depend on it.  The number of parts is
chosen the same way.  Fingerprints probe the values within reach of their parts
and every candidate is verified on all bits.

Buckets that very many fingerprints share are not paired.  Their members are
first linked with a centre; where a bucket still holds several components its
pairs of different components are found through hubs: values within one bit of
a member and within the remaining bits of its partner.  A hub's fingerprints
are linked as a star, so work grows with the members, not with their pairs.

Defined cases: a null or empty text has fingerprint zero, linked like any
other; fewer words than the shingle's are one shingle; very long texts are
hashed piece by piece; rows that share a doc_id are one document, linked through
each of its texts; a null doc_id has a fingerprint and no component; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import TOKEN_BYTES, append_columns, quoted
from panelweave.llm.components import connected_components
from panelweave.storage import stage

WIDTH = 3
WITHIN = 3
SEED = 42
BITS = 64
PARTS = (2, 3, 4, 5, 6)
#: More fingerprints in a bucket are linked by centre and hubs instead of pairs.  A member has about
#: 1,200 hubs, rows that are exchanged; up to about as many others it is cheaper to check them.
PAIRED = 1024
SEGMENT = 1 << 20
#: Cost of checking a candidate, in probed keys.
CANDIDATE = 0.2
_BLOCK_BITS = 8
_ROWS = 1 << 16

_PRINT = T.StructType([T.StructField("print", T.LongType()), T.StructField("n_shingles", T.LongType())])


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    plain, start = text.translate(TOKEN_BYTES), 0
    while start < len(plain):
        stop = plain.find(b" ", start + SEGMENT)
        stop = len(plain) if stop < 0 else stop
        yield plain[start:stop].split()
        start = stop


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, cut out of the joined words."""
    from xxhash import xxh64_intdigest

    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    cuts = zip((ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in cuts), np.uint64, len(words) - width + 1)


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the lowest first."""
    lanes = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)  # a byte a bit, 255 rows at most
    return sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None, width: int = WIDTH) -> tuple[int, int]:
    """(fingerprint as a signed number, number of shingles)."""
    counts, n, seen, tail = np.zeros(BITS, np.int64), 0, 0, []
    for words in _word_lists(text or b""):
        seen += len(words)
        words = tail + words
        if len(words) >= width:
            hashes = _hashes(words, width)
            counts += _set_bits(hashes)
            n += len(hashes)
        tail = words[len(words) - width + 1 :] if len(words) >= width else words
    if 0 < seen < width:
        counts, n = _set_bits(_hashes(tail, len(tail))), 1
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0]), n


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """The kept columns with ``print`` (a signed 64-bit number) and ``n_shingles``."""

    def make():
        return lambda texts: [list(column) for column in zip(*[fingerprint(t, width) for t in texts])]

    return append_columns(docs, text, _PRINT, make, keep=keep)


def as_hex(fingerprint_: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint_)), 16, "0")


def _bits(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _counted(classes: DataFrame, cells: int, count) -> np.ndarray:
    """Sums of ``cells`` counters over all fingerprints; each task sends its own once."""

    def run(batches):
        seen = np.zeros(cells, np.int64)
        for batch in batches:
            prints = batch.column(0).to_numpy()
            for start in range(0, len(prints), _ROWS):
                seen += count(prints[start : start + _ROWS])
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["cell", "n"])

    found = classes.select("print").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def correlated_parts(pairs: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of nearly equal size, correlated bits together.

    ``pairs[i, j]`` counts the fingerprints that have both bits.
    """
    share = np.diag(pairs) / max(total, 1)
    spread = np.sqrt(share * (1 - share))
    with np.errstate(all="ignore"):
        alike = np.abs(np.nan_to_num((pairs / max(total, 1) - np.outer(share, share)) / np.outer(spread, spread)))
    np.fill_diagonal(alike, 0)
    left, out = list(range(BITS)), []
    for size in [len(p) for p in np.array_split(np.arange(BITS), parts)]:
        part: list[int] = []
        while len(part) < size:
            near = alike[np.ix_(left, part or left)].sum(axis=1)
            part.append(left.pop(int(near.argmax())))
        out.append(sorted(part))
    return out


def _blocks(part: list[int]) -> list[list[int]]:
    return [[int(b) for b in block] for block in np.array_split(part, -(-len(part) // _BLOCK_BITS))]


def _values(bits: np.ndarray, block: list[int]) -> np.ndarray:
    return bits[:, block].astype(np.int64) @ (1 << np.arange(len(block)))


class Plan:
    """Parts with the cost of every share of units, for any fingerprint.

    ``counts[i][b]`` is the histogram of block b of part i.
    """

    def __init__(self, parts: list[list[int]], counts: list[list[np.ndarray]], total: int, within: int) -> None:
        self.parts, self.within, self.units = parts, within, within + 1
        self.blocks = [_blocks(p) for p in parts]
        values = np.arange(1 << _BLOCK_BITS)
        apart = np.array([bin(v).count("1") for v in range(1 << _BLOCK_BITS)])[values[:, None] ^ values[None, :]]
        self.near = []  # by part and block: share of fingerprints at each distance from a value
        for hists in counts:
            of = []
            for hist in hists:
                n = len(hist)
                of.append(np.stack([(apart[:n, :n] == e) @ hist for e in range(self.units)], axis=1) / max(total, 1))
            self.near.append(of)
        self.counts, self.total = counts, total
        self.keys = np.array([[0] + [sum(comb(len(p), e) for e in range(u)) for u in range(1, self.units + 1)] for p in parts])

    def _costs(self, part: int, at_distance: list[np.ndarray]) -> np.ndarray:
        """Rows x units: keys to probe and candidates behind them."""
        joint = at_distance[0]
        for more in at_distance[1:]:
            joint = np.stack([sum(joint[:, a] * more[:, e - a] for a in range(e + 1)) for e in range(self.units)], axis=1)
        within = np.concatenate((np.zeros((len(joint), 1)), np.cumsum(joint, axis=1)), axis=1)
        return self.keys[part] + CANDIDATE * self.total * within

    def share(self, costs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(units of each part, cost) at the least cost, row by row."""
        rows, units = len(costs[0]), self.units
        best = np.full((rows, units + 1), np.inf)
        best[:, 0] = 0
        taken = []
        for cost in costs:
            options = np.full((rows, units + 1, units + 1), np.inf)  # sum so far, units of this part
            for u in range(units + 1):
                options[:, u:, u] = best[:, : units + 1 - u] + cost[:, u : u + 1]
            taken.append(options.argmin(axis=2))
            best = options.min(axis=2)
        given, left = np.zeros((rows, len(costs)), np.int64), np.full(rows, units)
        for i in range(len(costs) - 1, -1, -1):
            given[:, i] = taken[i][np.arange(rows), left]
            left = left - given[:, i]
        return given, best[:, units]

    def shares(self, prints: np.ndarray) -> np.ndarray:
        bits = _bits(prints)
        costs = [
            self._costs(i, [near[_values(bits, block)] for near, block in zip(self.near[i], self.blocks[i])])
            for i in range(len(self.parts))
        ]
        return self.share(costs)[0]

    def mean_cost(self) -> float:
        """Expected cost of a fingerprint with the average shares of each part, keys of its own included."""
        costs = []
        for i in range(len(self.parts)):
            means = [(hist @ near / max(self.total, 1))[None, :] for hist, near in zip(self.counts[i], self.near[i])]
            costs.append(self._costs(i, means))
        return float(self.share(costs)[1][0]) + len(self.parts)

    def masks(self) -> list[int]:
        return [sum(1 << b for b in part) for part in self.parts]


def make_plan(classes: DataFrame, total: int, within: int, choices: tuple[int, ...] = PARTS) -> Plan:
    """The cheapest number of parts and their histograms, from two passes over the distinct fingerprints."""

    def pairs_of(prints):
        bits = _bits(prints).astype(np.float64)
        return (bits.T @ bits).astype(np.int64).ravel()

    pairs = _counted(classes, BITS * BITS, pairs_of).reshape(BITS, BITS)
    layouts = [correlated_parts(pairs, total, m) for m in choices]
    blocks = [block for layout in layouts for part in layout for block in _blocks(part)]
    size = 1 << _BLOCK_BITS

    def histograms(prints):
        bits = _bits(prints)
        return np.concatenate([np.bincount(_values(bits, block), minlength=size) for block in blocks])

    flat = iter(_counted(classes, len(blocks) * size, histograms).reshape(len(blocks), size))
    plans = []
    for layout in layouts:
        counts = [[next(flat)[: 1 << len(block)] for block in _blocks(part)] for part in layout]
        plans.append(Plan(layout, counts, total, within))
    return min(plans, key=Plan.mean_cost)


def _ball(bits: list[int], radius: int) -> np.ndarray:
    """Flips of up to ``radius`` of the bits, as signed numbers, fewest first."""
    flips = [sum(1 << b for b in chosen) for e in range(radius + 1) for chosen in combinations(bits, e)]
    return np.array(flips, np.uint64).view(np.int64)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


_PROBES = "part int, key long, apart int, print long, node long"


def _probes(classes: DataFrame, plan: Plan) -> DataFrame:
    """The keys that each fingerprint asks for; ``apart`` is the distance to its own."""
    shipped = classes.sparkSession.sparkContext.broadcast(plan)  # histograms of fixed size

    def run(batches):
        plan = shipped.value
        masks = [np.int64(_signed(m)) for m in plan.masks()]
        balls = {}
        for batch in batches:
            every, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for start in range(0, len(every), 4096):
                prints, own = every[start : start + 4096], nodes[start : start + 4096]
                given = plan.shares(prints)
                for part, units in ((p, u) for p in range(len(masks)) for u in range(1, plan.units + 1)):
                    at = np.flatnonzero(given[:, part] == units)
                    if not len(at):
                        continue
                    if (part, units) not in balls:
                        flips = _ball(plan.parts[part], units - 1)
                        balls[part, units] = flips, np.array([int(f).bit_count() if f >= 0 else (int(f) & (2**64 - 1)).bit_count() for f in flips], np.int32)
                    flips, apart = balls[part, units]
                    step = max(1, _ROWS // len(flips))
                    for first in range(0, len(at), step):
                        some = at[first : first + step]
                        keys = ((prints[some] & masks[part])[:, None] ^ flips[None, :]).ravel()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(keys), part, np.int32)), pa.array(keys), pa.array(np.tile(apart, len(some))),
                             pa.array(np.repeat(prints[some], len(flips))), pa.array(np.repeat(own[some], len(flips)))],
                            names=["part", "key", "apart", "print", "node"],
                        )

    return classes.select("print", "node").mapInArrow(run, _PROBES)


def _alike(a: str, b: str, within: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= within


def _hub_rows(met: DataFrame, plan: Plan) -> DataFrame:
    """(part, hub, exact, asks, node) of the members and visitors of buckets with several components.

    ``met`` has part, key, apart (0: a member), print, node and rare (a member of
    another component than most).  Members stand at the hubs within one bit; a
    rare one, or a visitor, asks at those within the bits that then remain.
    """
    parts, masks, within = plan.parts, [_signed(m) for m in plan.masks()], plan.within

    def run(batches):
        rest = [[b for b in range(BITS) if b not in part] for part in parts]
        balls = {}

        def ball(part, radius):
            if (part, radius) not in balls:
                balls[part, radius] = _ball(rest[part], radius)
            return balls[part, radius]

        def rows(part, base, nodes, flips, exact, asks):
            step = max(1, _ROWS // len(flips))
            for first in range(0, len(base), step):
                hubs = (base[first : first + step, None] ^ flips[None, :]).ravel()
                n = len(hubs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(hubs), pa.array(np.full(n, exact)), pa.array(np.full(n, asks)),
                     pa.array(np.repeat(nodes[first : first + step], len(flips)))],
                    names=["part", "hub", "exact", "asks", "node"],
                )

        for batch in batches:
            part_of, key, apart, prints, nodes, rare = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            for part in np.unique(part_of):
                mine = part_of == part
                base = (prints & ~np.int64(masks[part])) | key
                member = mine & (apart == 0)
                yield from rows(part, base[member], nodes[member], ball(part, min(1, within)), False, False)
                yield from rows(part, base[member], nodes[member], ball(part, 0), True, False)
                odd = member & rare
                yield from rows(part, base[odd], nodes[odd], ball(part, max(0, within - 1)), False, True)
                for e in range(1, within + 1):
                    at = mine & (apart == e)
                    if at.any():
                        yield from rows(part, base[at], nodes[at], ball(part, max(0, within - 1 - e)), e == within, True)

    columns = met.select("part", "key", "apart", "print", "node", "rare")
    return columns.mapInArrow(run, "part int, hub long, exact boolean, asks boolean, node long")


def _hub_links(met: DataFrame, labels: DataFrame, plan: Plan) -> DataFrame:
    """Links of fingerprints of different components that share a crowded bucket."""
    labelled = met.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = stage(labelled, "labelled")
    members = labelled.where("apart = 0").groupBy("part", "key", "label").agg(F.count("*").alias("n"))
    most = members.groupBy("part", "key").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("most"))
    several = labelled.groupBy("part", "key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1")
    open_ = stage(several.join(most, ["part", "key"]).select("part", "key", "most"), "open")
    rows = labelled.join(open_, ["part", "key"]).withColumn("rare", F.col("label") != F.col("most"))
    hubs = stage(_hub_rows(rows, plan), "hubs")
    hub = ["part", "hub", "exact"]
    heads = hubs.groupBy(*hub).agg(F.min(F.when(~F.col("asks"), F.col("node"))).alias("head"), F.max("asks").alias("asked"))
    heads = stage(heads.where("asked and head is not null").select(*hub, "head"), "heads")
    return hubs.join(heads, hub).where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()


def link_fingerprints(classes: DataFrame, within: int = WITHIN, paired: int = PAIRED, parts: tuple[int, ...] = PARTS) -> DataFrame:
    """(node, label) for the nodes with a link: the least node reachable.

    ``classes`` has a row for each distinct fingerprint: print, node and docs.
    """
    total = classes.count()
    plan = make_plan(classes, total, within, parts)
    cell = ["part", "key"]
    own = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(plan.masks())]))
    index = classes.select("print", "node", "docs", own.alias("cell")).select("cell.part", "cell.key", "print", "node", "docs")
    probes = stage(_probes(classes, plan), "probes")
    crowded = stage(index.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > paired).select(*cell), "crowded")

    ask = probes.join(crowded, cell, "left_anti").select(*cell, F.col("print").alias("print_a"), F.col("node").alias("a"))
    answer = index.join(crowded, cell, "left_anti").select(*cell, F.col("print").alias("print_b"), F.col("node").alias("b"))
    near = (F.col("print_a") < F.col("print_b")) & _alike("print_a", "print_b", within)
    links = stage(ask.join(answer, cell).where(near).select("a", "b"), "links")
    if crowded.limit(1).count():
        members = stage(index.join(crowded, cell), "members")
        best = F.max_by(F.struct("print", "node"), F.struct("docs", -F.col("node"))).alias("best")
        centres = stage(members.groupBy(*cell).agg(best).select(*cell, F.col("best.print").alias("middle"), F.col("best.node").alias("centre")), "centres")
        visitors = probes.where("apart > 0").join(crowded, cell)
        met = members.select(*cell, F.lit(0).alias("apart"), "print", "node").unionByName(visitors)
        met = stage(met, "met")
        spokes = met.join(centres, cell).where((F.col("node") != F.col("centre")) & _alike("print", "middle", within))
        links = links.union(stage(spokes.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "spokes"))
        links = links.union(stage(_hub_links(met, stage(connected_components(links), "labels"), plan), "hub_links"))
    return connected_components(links)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, within: int = WITHIN, **options) -> DataFrame:
    """doc_id, print, n_shingles, component_id: a row for each row of ``docs``."""
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    signed = stage(fingerprints(rows, "text", ["doc_id"], width), "fingerprints")
    known = signed.where("doc_id is not null")
    classes = known.groupBy("print").agg(F.min("doc_id").alias("node"), F.count("*").alias("docs"))
    # an id with several texts may be the least of several fingerprints: such a node stands for all of them
    classes = stage(classes, "classes")
    labels = link_fingerprints(classes, within, **options)
    several = known.groupBy("doc_id").agg(F.min("print").alias("x"), F.max("print").alias("y")).where("x != y").select("doc_id")
    several = stage(several, "several")
    if several.limit(1).count():  # the texts of one id link the fingerprints that they have
        labelled = classes.join(labels, "node", "left").select("print", F.coalesce("label", "node").alias("label"))
        more = known.join(several, "doc_id", "left_semi").join(labelled, "print").select(F.col("doc_id").alias("a"), F.col("label").alias("b"))
        labels = connected_components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
    found = signed.join(classes.select("print", "node"), "print", "left").join(labels, "node", "left")
    least = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "node"))
    return found.select("doc_id", "print", "n_shingles", least.alias("component_id"))
