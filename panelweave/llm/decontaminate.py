"""Benchmark decontamination: one Aho-Corasick pass over normalised words.

Benchmark items are cut into windows of ``width`` words; an item of fewer, but
not none, is one window.  All windows go into one automaton whose symbols are
word numbers, and every text is scanned once.  Matches are mapped back to
character offsets of the original text.

Defined cases: a null or empty text has no words and no hits; a null or empty
item has no windows; an item with a null id marks words without being listed;
repeated rows are each scanned; very long texts are scanned whole.  The
automaton is broadcast in shards of a bounded size; a benchmark that needs more
than one shard is scanned shard by shard with the hits carried along.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import WORD_BYTES, append_columns, quoted
from panelweave.storage import stage

WIDTH = 10
SHARD_BYTES = 8 << 20

_WINDOWS = T.StructType([T.StructField("windows", T.ArrayType(T.StringType()))])
_HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("runs", T.ArrayType(T.IntegerType())),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
])


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def benchmark_windows(items: DataFrame, width: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item_id as text, window): words joined by spaces."""

    def make():
        def cut(texts):
            out = []
            for t in texts:
                words = [w.decode("utf-8", "replace") for w in words_of(t)]
                last = max(1, len(words) - width + 1) if words else 0
                out.append([" ".join(words[i : i + width]) for i in range(last)])
            return [out]

        return cut

    cut = append_columns(items, text, _WINDOWS, make, keep=[item_id])
    return cut.select(quoted(item_id).cast("string").alias("item"), F.explode("windows").alias("window")).distinct()


def _automaton(pairs: list[tuple[str | None, str]]):
    import ahocorasick

    numbers: dict[bytes, int] = {}
    owners: dict[tuple, list] = {}
    for item, window in pairs:
        key = tuple(numbers.setdefault(w.encode(), len(numbers) + 1) for w in window.split(" "))
        owners.setdefault(key, []).append(item)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, items in owners.items():
        automaton.add_word(key, (len(key), [i for i in items if i is not None]))
    automaton.make_automaton()
    return automaton, numbers


def _merged(runs: list[tuple[int, int]]) -> list[list[int]]:
    """Sorted, disjoint [first, last] word runs."""
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def _spans(text: bytes, runs: list[list[int]]) -> list[list[int]]:
    """Character offsets [begin, end) of word runs in the original text."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [[int(chars[begins[a]]), int(chars[ends[b]])] for a, b in runs]


def _scan(docs: DataFrame, text: str, windows: list[tuple[str | None, str]], keep: list[str], earlier: bool) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(windows)

    def make():
        automaton, numbers = _automaton(shipped.value)
        number = numbers.get

        def scan(texts, old_runs=None, old_items=None):
            columns = [[], [], [], [], []]
            for at, t in enumerate(texts):
                words = words_of(t)
                runs, items = [], set()
                if earlier:
                    flat = old_runs[at]
                    runs += list(zip(flat[::2], flat[1::2]))
                    items |= set(old_items[at])
                if words and len(automaton):
                    for end, (length, owners) in automaton.iter(tuple([number(w, 0) for w in words])):
                        runs.append((end - length + 1, end))
                        items.update(owners)
                runs = _merged(runs)
                columns[0].append(len(words))
                columns[1].append(sum(b - a + 1 for a, b in runs))
                columns[2].append([x for run in runs for x in run])
                columns[3].append(sorted(items))
                columns[4].append(_spans(t, runs) if runs else [])
            return columns

        return scan

    return append_columns(docs, text, _HITS, make, keep=keep, extra=["runs", "item_ids"] if earlier else ())


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    width: int = WIDTH,
    text: str = "text",
    keep: list[str] | None = None,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The kept columns of ``docs`` with n_words, n_hit, runs, item_ids and spans.

    ``runs`` lists first and last word numbers of the disjoint hit runs,
    ``spans`` their character offsets in the text, ``item_ids`` the items with
    an occurring window, sorted as strings.
    """
    spark = docs.sparkSession
    windows = stage(benchmark_windows(items, width), "windows")
    size = windows.agg(F.sum(F.octet_length("window") + 16)).first()[0] or 0
    shards = -(-size // shard_bytes) or 1
    kept = [c for c in (docs.columns if keep is None else keep) if c not in _HITS.fieldNames()]
    out = docs
    for shard in range(shards):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(shards)) == shard)
        pairs = [(r["item"], r["window"]) for r in part.collect()]  # at most about shard_bytes
        last = shard == shards - 1
        out = _scan(out, text, pairs, kept if last or text in kept else [*kept, text], shard > 0)
        if not last:
            out = stage(out, "hits")
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", min_share: float = 0.0) -> DataFrame:
    """Documents whose share of hit words is at most ``min_share``, in their own columns."""
    marker = "_hits"
    while marker in docs.columns:
        marker += "_"
    packed = docs.select(F.struct("*").alias(marker), quoted(text).alias("text"))
    found = find_contamination(packed, items, keep=[marker])
    share = F.col("n_hit") / F.greatest(F.col("n_words"), F.lit(1))
    return found.where(share <= min_share).select(
        *[F.col(marker).getField(c).alias(c) for c in docs.columns]
    )
