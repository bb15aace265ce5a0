import math
import random

import numpy as np
from pyspark.sql import functions as F

from panelweave.llm import langid, quality
from panelweave.llm.queries import QUERIES
from tests.llm.helpers import documents, prose

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op4_byte_cnn_language"](spark, SF).join(docs, "doc_id").where("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all()


def test_quality_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = QUERIES["op3_quality_fm"](spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    assert (found.quality == found.predicted).mean() > 0.95
    assert found.score.between(0, 1).all()


def test_pair_term_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    size = quality.WORD_BUCKETS + len(quality.STATS) * (quality.BINS + 1)
    machine = quality.Machine(np.sort(rng.normal(size=(len(quality.STATS), quality.BINS - 1)), axis=1), 0.3, rng.normal(size=size), rng.normal(size=(size, 4)) * 0.3)
    stats, buckets = rng.normal(size=len(quality.STATS)), np.array([3, 17, 900])
    at, x = machine.inputs(stats, buckets, machine.edges)
    raw = machine.w0 + sum(machine.w[i] * a for i, a in zip(at, x))
    raw += sum(machine.v[i] @ machine.v[j] * a * b for n, (i, a) in enumerate(zip(at, x)) for j, b in list(zip(at, x))[:n])
    assert math.isclose(machine.score(stats, buckets), 1 / (1 + math.exp(-raw)), rel_tol=1e-5)


def test_folded_network_is_the_network():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, langid.CLASSES, (200, langid.WINDOW)).astype(np.uint8), rng.integers(0, 3, 200)
    w = langid.fit(x, y, 3, epochs=1)
    emb, pooled = w["e"][x[:5]], []
    for k in langid.WIDTHS:
        out = [emb[:, i : i + k].reshape(5, -1) @ w[f"w{k}"] for i in range(langid.WINDOW - k + 1)]
        pooled.append(np.max(out, axis=0) + w[f"b{k}"])
    logits = np.maximum(np.concatenate(pooled, 1), 0) @ w["o"] + w["ob"]
    want = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    assert np.allclose(langid.Predictor(w).log_probabilities(x[:5]), want, atol=1e-3)


LETTERS = {"aa": "abcde", "bb": "vwxyz"}


def spoken(spark):
    rng = random.Random(3)
    word = lambda lang: "".join(rng.choice(LETTERS[lang]) for _ in range(6))
    rows = [(i, " ".join(word(lang) for _ in range(40)), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    odd = [(500, None, "aa"), (501, "", "bb"), (502, "12 !? 3", "aa"), (None, rows[0][1], "aa"), (503, rows[1][1] * 300, None), (503, "日本語", None)]
    return documents(spark, rows + odd)


def test_language_cases(spark):
    docs = spoken(spark)
    languages, w = langid.fit_languages(docs.where("doc_id < 100"))
    assert languages == ["aa", "bb"]
    found = {(r["doc_id"], r["text"]): r for r in langid.predict(docs, languages, w).collect()}
    for (doc_id, text), r in found.items():
        if doc_id in (500, 501, 502):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif text != "日本語":
            assert r["lang_pred"] == ("aa" if text[0] in "abcde" else "bb")
        else:
            assert r["lang_pred"] in languages
    assert langid.fit_languages(docs.where("false")) == ([], {})
    assert {r["lang_pred"] for r in langid.predict(docs, [], {}).collect()} == {"und"}
    assert langid.predict(docs.where("false"), languages, w).count() == 0


def test_language_filter(spark):
    docs = spoken(spark)
    kept = langid.in_known_language(docs)
    assert kept.columns == docs.columns
    gone = docs.exceptAll(kept)
    assert {500, 501, 502} <= {r["doc_id"] for r in gone.collect()} and gone.count() <= 4
    # nothing to learn from: letters decide
    assert langid.in_known_language(docs.withColumn("lang", F.lit(None).cast("string"))).where("doc_id = 0").count() == 1


def test_quality_cases(spark):
    good = [(i, prose(i, 60) + ".") for i in range(80)]
    bad = [(100 + i, "### !!! " * 30 + prose(i, 5)) for i in range(80)]
    odd = [(300, None), (301, ""), (302, prose(9, 20_000)), (None, "no id"), (0, "again")]
    docs = documents(spark, good + bad + odd)
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + bad] + [(300, None, None), (None, 1, 0), (301, 1, 0), (301, 1, 0)], "doc_id long, quality int, toxic int")
    machine = quality.fit_quality(docs, labels)
    scored = quality.score_quality(docs, machine).collect()
    assert len(scored) == 165 and all(0 <= r["score"] <= 1 for r in scored)
    assert all(r["score"] > 0.5 for r in scored if r["doc_id"] is not None and 1 <= r["doc_id"] < 100)
    assert all(r["score"] < 0.5 for r in scored if r["doc_id"] is not None and 100 <= r["doc_id"] < 200)
    assert quality.fit_quality(docs, labels.where("false")) is None
    assert {r["score"] for r in quality.score_quality(docs, None).collect()} == {0.5}
    assert quality.score_quality(docs.where("false"), machine).count() == 0
