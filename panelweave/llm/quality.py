"""Quality classifier: a factorisation machine over words, structure and metadata.

Features of a document: its distinct words, hashed; statistics of its structure
(lengths, character kinds, repeated words and lines), each put into the bin
between quantiles of the sample; and its metadata, the recorded number of
characters and whether it agrees with the text.  The score is

    sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2))

whose pair term takes time linear in the features.  Training is AdaGrad in numpy
on a bounded sample of labelled documents.

Defined cases: a null text counts as empty and is scored; rows without label or
id are not learned from; null metadata is a bin of its own; with nothing to
learn from every score is 0.5; very long texts are read whole.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import TOKEN_BYTES, append_columns, quoted

#: Most labelled documents that are learned from.
SAMPLE_DOCS = 12_000
WORD_BUCKETS = 1 << 14
BINS = 16
FACTORS = 8
EPOCHS = 10
WORDS_KNOWN = 500_000

STATS = (
    "chars", "words", "lines", "word_length", "line_length", "distinct_words", "distinct_lines", "top_word",
    "upper", "lower", "digits", "blanks", "other_bytes", "marks", "stops", "commas", "recorded", "recorded_off",
)
_KINDS = bytes(
    1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if b in b" \t\n\r\x0b\x0c"
    else 5 if b >= 128 else 6 if b in b".?" else 7 if b == 44 else 0 for b in range(256)
)
_FEATURES = T.StructType([
    T.StructField("stats", T.ArrayType(T.DoubleType())),
    T.StructField("buckets", T.ArrayType(T.IntegerType())),
])
_SCORE = T.StructType([T.StructField("score", T.DoubleType())])


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KNOWN:
            self.clear()
        value = self[word] = zlib.crc32(word) % WORD_BUCKETS
        return value


def features(text: bytes | None, recorded: int | None, known: dict) -> tuple[list[float], np.ndarray]:
    """Structure statistics and the sorted buckets of the distinct words."""
    t = text or b""
    words, lines = t.translate(TOKEN_BYTES).split(), t.split(b"\n")
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    kinds = np.bincount(np.frombuffer(t.translate(_KINDS), np.uint8), minlength=8) / max(1, len(t))
    chars = len(t.decode("utf-8", "replace"))
    n, m = max(1, len(words)), max(1, len(lines))
    full = [x for x in lines if x.strip()]
    off = float("nan") if recorded is None else abs(recorded - chars) / max(1, chars)
    stats = [
        chars, len(words), len(lines), len(t) / n, len(t) / m, len(counts) / n, len(set(full)) / max(1, len(full)), max(counts.values(), default=0) / n,
        kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[0], kinds[6], kinds[7], float("nan") if recorded is None else recorded, off,
    ]
    return [float(s) for s in stats], np.unique(np.fromiter(map(known.__getitem__, counts), np.int64, len(counts)))


class Machine:
    """Weights with the bin edges that belong to them."""

    def __init__(self, edges: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> None:
        self.edges, self.w0, self.w, self.v = edges, w0, w, v

    @staticmethod
    def binned(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Feature numbers behind the word buckets, one a statistic; NaN has the last bin."""
        width = BINS + 1
        bins = np.array([BINS if np.isnan(s) else np.searchsorted(e, s, "right") for s, e in zip(stats, edges)])
        return WORD_BUCKETS + np.arange(len(edges)) * width + bins

    @staticmethod
    def inputs(stats, buckets: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate((buckets, Machine.binned(np.asarray(stats), edges)))
        x = np.ones(len(at), np.float32)
        if len(buckets):
            x[: len(buckets)] = len(buckets) ** -0.5
        return at, x

    def score(self, stats, buckets: np.ndarray) -> float:
        at, x = self.inputs(stats, buckets, self.edges)
        vx = self.v[at] * x[:, None]
        raw = self.w0 + self.w[at] @ x + 0.5 * ((vx.sum(axis=0) ** 2) - (vx**2).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def fit(stats: np.ndarray, buckets: list[np.ndarray], y: np.ndarray, seed: int = 0, epochs: int = EPOCHS) -> Machine:
    rng = np.random.default_rng(seed)
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.array([np.quantile(c[~np.isnan(c)], quantiles) if (~np.isnan(c)).any() else np.zeros(BINS - 1) for c in stats.T])
    size = WORD_BUCKETS + len(STATS) * (BINS + 1)
    rate = y.mean()
    w0 = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    w, v = np.zeros(size, np.float32), rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32)
    gw, gv = np.full(size, 1e-2, np.float32), np.full((size, FACTORS), 1e-2, np.float32)
    rows = [Machine.inputs(s, b, edges) for s, b in zip(stats, buckets)]
    weight = np.where(y == 1, 1.0, min(4.0, max(1.0, rate / max(1e-3, 1 - rate)) ** 0.5))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(y), 64):
            part = order[start : start + 64]
            at = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([rows[i][1] for i in part])
            lengths = np.array([len(rows[i][0]) for i in part])
            first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            vx = v[at] * x[:, None]
            sums = np.add.reduceat(vx, first, axis=0)
            raw = w0 + np.add.reduceat(w[at] * x, first) + 0.5 * ((sums**2) - np.add.reduceat(vx**2, first, axis=0)).sum(axis=1)
            error = ((1 / (1 + np.exp(-np.clip(raw, -30, 30)))) - y[part]) * weight[part] / len(part)
            e = np.repeat(error, lengths).astype(np.float32) * x
            seen, inverse = np.unique(at, return_inverse=True)
            dw = np.bincount(inverse, e, len(seen)) + 1e-5 * w[seen]
            pulled = e[:, None] * (np.repeat(sums, lengths, axis=0) - vx)
            dv = np.stack([np.bincount(inverse, pulled[:, f], len(seen)) for f in range(FACTORS)], axis=1) + 1e-4 * v[seen]
            gw[seen] += dw**2
            gv[seen] += dv**2
            w[seen] -= 0.1 * dw / np.sqrt(gw[seen])
            v[seen] -= 0.05 * dv / np.sqrt(gv[seen])
            w0 -= 0.05 * float(error.sum())
    return Machine(edges, w0, w, v)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", n_chars: str = "n_chars", doc_id: str = "doc_id", sample: int = SAMPLE_DOCS, seed: int = 0) -> Machine | None:
    """Learn from at most ``sample`` labelled documents, drawn by a hash of their ids."""
    marked = labels.select(quoted(doc_id).alias("id"), quoted(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    drawn = marked.orderBy(F.xxhash64(F.lit(seed), F.col("id").cast("string")), "id", "label").limit(sample)
    texts = docs.select(quoted(doc_id).alias("id"), quoted(text).alias("text"), quoted(n_chars).cast("long").alias("n_chars"))
    found = texts.join(F.broadcast(drawn), "id")  # ``sample`` rows at most

    def make():
        known = _Buckets()

        def of(texts, recorded):
            both = [features(t, r, known) for t, r in zip(texts, recorded)]
            return [[s for s, _ in both], [b for _, b in both]]

        return of

    rows = append_columns(found, "text", _FEATURES, make, keep=["id", "label"], extra=["n_chars"]).toArrow().sort_by([("id", "ascending")])
    if not rows.num_rows:
        return None
    stats = np.array(rows.column("stats").to_pylist())
    buckets = [np.array(b, np.int64) for b in rows.column("buckets").to_pylist()]
    return fit(stats, buckets, rows.column("label").to_numpy().astype(float), seed)


def score_quality(docs: DataFrame, machine: Machine | None, text: str = "text", n_chars: str = "n_chars", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with ``score``, the probability of label 1."""
    parts = None if machine is None else (machine.edges, machine.w0, machine.w, machine.v)
    shipped = docs.sparkSession.sparkContext.broadcast(parts)

    def make():
        known, model = _Buckets(), None if shipped.value is None else Machine(*shipped.value)

        def score(texts, recorded):
            return [[0.5 if model is None else model.score(*features(t, r, known)) for t, r in zip(texts, recorded)]]

        return score

    return append_columns(docs, text, _SCORE, make, keep=keep, extra=[n_chars])
