"""Language identification by a byte convolutional network.

A byte is a letter a-z (upper case folded), a byte above 127, or blank.  The
network embeds bytes, runs filters of several widths over a window of fixed
length, max-pools each filter over the window, and ends in a softmax.  It is
trained in numpy on windows of a bounded sample of labelled documents.  For
prediction the embedding and the filters are folded into tables by byte pair,
so a filter is a sum of looked-up rows.  Every window of a text is scored; the
text's distribution is the mean of the windows' log distributions, weighted by
letters, renormalised.

Defined cases: ``und`` with score 0 for a null text, one without letters, or if
nothing could be learned; documents without language or id are not learned
from; very long texts are cut into as many windows as they need; repeated rows
are predicted each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import append_columns, quoted

UNKNOWN = "und"
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Bounds of the sample that is learned from.
DOCS_A_LANGUAGE = 1500
WINDOWS_A_DOC = 4
EPOCHS = 4
LEAST_STEPS = 600  # more epochs where the sample is small
CHUNK = 1024  # windows at a time

CLASSES = 27 + 128
BYTE_CLASS = bytes(
    b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else b - 128 + 27 if b >= 128 else 0 for b in range(256)
)
_SAMPLE = T.StructType([T.StructField("cut", T.BinaryType())])
_GUESS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def _windows(text: bytes) -> np.ndarray:
    """The whole text in rows of WINDOW byte classes, the last filled with blanks."""
    n = -(-len(text) // WINDOW)
    return np.frombuffer(text.translate(BYTE_CLASS).ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def has_letter(text: bytes | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def training_windows(docs: DataFrame, text: str, lang: str, doc_id: str, docs_a_language: int, seed: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, windows, language numbers) of a sample that a hash of the ids draws."""
    known = docs.select(quoted(doc_id).alias("id"), quoted(lang).alias("lang"), quoted(text).alias("text")).where("lang is not null and id is not null and text is not null")
    rates = known.groupBy("lang").agg(F.least(F.lit(1.0), 1.3 * docs_a_language / F.count("*")).alias("rate"))
    h = F.xxhash64(F.lit(seed), F.col("id").cast("string"))  # rates: a row a language
    drawn = known.withColumn("h", h).join(F.broadcast(rates), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("rate") * (1 << 30))

    def make():
        def cut(texts):
            out = []
            for t in texts:
                rows = _windows(t) if has_letter(t) else np.empty((0, WINDOW), np.uint8)
                at = np.unique(np.linspace(0, len(rows) - 1, min(len(rows), WINDOWS_A_DOC)).astype(int)) if len(rows) else []
                out.append(rows[at].tobytes() if len(rows) else None)
            return [out]

        return cut

    cut = append_columns(drawn, "text", _SAMPLE, make, keep=["lang", "h"]).where("cut is not null")
    first = Window.partitionBy("lang").orderBy("h", "cut")  # rows of the sample only
    rows = cut.withColumn("nr", F.row_number().over(first)).where(F.col("nr") <= docs_a_language).orderBy("lang", "nr").collect()
    languages = sorted({r["lang"] for r in rows})
    xs = [np.frombuffer(bytes(r["cut"]), np.uint8).reshape(-1, WINDOW) for r in rows]
    ys = [np.full(len(x), languages.index(r["lang"])) for x, r in zip(xs, rows)]
    if not rows:
        return [], np.empty((0, WINDOW), np.uint8), np.empty(0, int)
    return languages, np.concatenate(xs), np.concatenate(ys)


def fit(x: np.ndarray, y: np.ndarray, classes: int, seed: int = 0, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Weights of the network by Adam on the cross entropy; languages weigh alike."""
    rng = np.random.default_rng(seed)
    d, f = EMBEDDING, FILTERS
    w = {"e": rng.normal(0, 0.3, (CLASSES, d)), "o": rng.normal(0, 0.1, (f * len(WIDTHS), classes)), "ob": np.zeros(classes)}
    for k in WIDTHS:
        w[f"w{k}"], w[f"b{k}"] = rng.normal(0, (k * d) ** -0.5, (k * d, f)), np.zeros(f)
    w = {name: v.astype(np.float32) for name, v in w.items()}
    moments = {name: (np.zeros_like(v), np.zeros_like(v)) for name, v in w.items()}
    weight = (len(y) / (classes * np.maximum(np.bincount(y, minlength=classes), 1))).astype(np.float32)
    step, batch = 0, 128
    for _ in range(max(epochs, -(-LEAST_STEPS // max(1, -(-len(y) // batch))))):
        order = rng.permutation(len(y))
        for start in range(0, len(y), batch):
            at = order[start : start + batch]
            xb, yb, n = x[at].astype(np.int64), y[at], len(at)
            emb = w["e"][xb]
            pooled, places, columns = [], [], []
            for k in WIDTHS:
                view = np.lib.stride_tricks.sliding_window_view(emb, k, axis=1)  # n, places, d, k
                cols = view.transpose(0, 1, 3, 2).reshape(n, -1, k * d)
                out = cols @ w[f"w{k}"]
                best = out.argmax(axis=1)
                pooled.append(np.take_along_axis(out, best[:, None, :], 1)[:, 0] + w[f"b{k}"])
                places.append(best), columns.append(cols)
            raw = np.concatenate(pooled, axis=1)
            hidden = np.maximum(raw, 0)
            logits = hidden @ w["o"] + w["ob"]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), yb] -= 1
            p *= weight[yb][:, None] / n
            g = {"o": hidden.T @ p, "ob": p.sum(axis=0), "e": np.zeros_like(w["e"])}
            back = (p @ w["o"].T) * (raw > 0)
            for i, k in enumerate(WIDTHS):
                part = back[:, i * f : (i + 1) * f]
                chosen = columns[i][np.arange(n)[:, None], places[i]]  # n, f, k*d
                g[f"w{k}"] = np.einsum("nfc,nf->cf", chosen, part)
                g[f"b{k}"] = part.sum(axis=0)
                into = (part[:, :, None] * w[f"w{k}"].T[None]).reshape(n, f, k, d)
                bytes_at = xb[np.arange(n)[:, None, None], places[i][:, :, None] + np.arange(k)]
                np.add.at(g["e"], bytes_at, into)
            step += 1
            for name in w:
                m, v = moments[name]
                m += 0.1 * (g[name] - m)
                v += 0.001 * (g[name] ** 2 - v)
                w[name] -= 3e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


class Predictor:
    """The folded network: for each width a table by byte pair, or by pair and byte."""

    def __init__(self, w: dict[str, np.ndarray]) -> None:
        d, self.w = EMBEDDING, w
        part = {k: [w["e"] @ w[f"w{k}"][j * d : (j + 1) * d] for j in range(k)] for k in WIDTHS}
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(CLASSES * CLASSES, -1)
        self.terms = {}  # width -> (table, symbols it spans, offset)
        for k in WIDTHS:
            terms = [(pair(part[k][j], part[k][j + 1]), 2, j) for j in range(0, k - 1, 2)]
            self.terms[k] = terms + ([(part[k][k - 1], 1, k - 1)] if k % 2 else [])

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        ones = x.astype(np.int32)
        pairs = ones[:, :-1] * CLASSES + ones[:, 1:]
        pooled = []
        for k in WIDTHS:
            length, total = WINDOW - k + 1, None
            for rows, span, offset in self.terms[k]:
                at = (pairs if span == 2 else ones)[:, offset : offset + length]
                got = np.take(rows, at, axis=0)
                total = got if total is None else np.add(total, got, out=total)
            pooled.append(total.max(axis=1) + self.w[f"b{k}"])
        logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.w["o"] + self.w["ob"]
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def predict(docs: DataFrame, languages: list[str], w: dict[str, np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with lang_pred and score."""
    shipped = docs.sparkSession.sparkContext.broadcast((languages, w))

    def make():
        names, weights = shipped.value
        network = Predictor(weights) if names else None

        def guess(texts):
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            of, waiting, sums = [], [], np.zeros((len(texts), max(1, len(names))))

            def flush():
                if of:
                    x = np.concatenate(waiting)
                    logs = network.log_probabilities(x) * np.maximum((x > 0).sum(axis=1), 1)[:, None]
                    np.add.at(sums, np.concatenate(of), logs)
                    letters_of = np.bincount(np.concatenate(of), np.maximum((x > 0).sum(axis=1), 1), len(texts))
                    letters[:] += letters_of
                    of.clear(), waiting.clear()

            letters, held, asked = np.zeros(len(texts)), 0, []
            for i, t in enumerate(texts):
                if network is None or not has_letter(t):
                    continue
                asked.append(i)
                rows = _windows(t)
                for start in range(0, len(rows), CHUNK):
                    part = rows[start : start + CHUNK]
                    of.append(np.full(len(part), i)), waiting.append(part)
                    held += len(part)
                    if held >= CHUNK:
                        flush()
                        held = 0
            flush()
            for i in asked:
                mean = sums[i] / letters[i]
                p = np.exp(mean - mean.max())
                p /= p.sum()
                best = int(p.argmax())
                langs[i], scores[i] = names[best], float(p[best])
            return [langs, scores]

        return guess

    return append_columns(docs, text, _GUESS, make, keep=keep)


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", docs_a_language: int = DOCS_A_LANGUAGE, seed: int = 0) -> tuple[list[str], dict[str, np.ndarray]]:
    """Learn from ``docs``; at most ``docs_a_language`` documents of each language are read."""
    languages, x, y = training_windows(docs, text, lang, doc_id, docs_a_language, seed)
    return languages, fit(x, y, len(languages), seed) if languages else {}


def in_known_language(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", least: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs``, in their own columns, whose language is recognised with ``least`` certainty.

    Learned from the rows of ``docs`` that name a language, but for each fifth by
    checksum of the id.  Where nothing can be learned, every text with a letter stays.
    """
    held_out = F.coalesce(F.crc32(quoted(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))
    languages, weights = fit_languages(docs.where(~held_out), text, lang, doc_id, **options)
    packed = docs.select(F.struct("*").alias("row"), quoted(text).alias("text"))
    guessed = predict(packed, languages or [UNKNOWN + "?"], weights or fit(np.empty((0, WINDOW), np.uint8), np.empty(0, int), 1), keep=["row"])
    kept = guessed.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
