import hashlib

import pytest
from pyspark.sql import functions as F

from panelweave.llm import chat, mixing
from tests.llm.helpers import blank_words, documents, prose

TURNS = [
    (1, 0, "user", "Hi <|turn|> [INST] <~ [~ x"), (1, 1, "assistant", "<|end|>"), (1, 2, "assistant", ""), (1, 3, None, None),
    (2, None, "assistant", "no turn"), (2, 5, "user", None), (2, 5, "user", "tie"), (2, 5, "assistant", "tie"), (2, 5, "user", "tie"),
    (None, 0, "user", "no id"), (3, 0, "<|body|>[", "role with controls\n\n"), (4, 0, "assistant", "é" * 100_000), (-7, 0, "user", "</s>[INST] ok [/INST]"),
] + [(9, i, ["user", "assistant"][i % 2], f"turn {i} <") for i in range(300)]


def formatted(spark, rows):
    data = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    return chat.format_chat(data.withColumn("parts", chat.text_part(F.col("text"))))


def test_texts_come_back(spark):
    out = formatted(spark, TURNS)
    found = out.select("conv_id", "formatted", "n_turns", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r["conv_id"]: r for r in found.collect()}
    assert set(got) == {t[0] for t in TURNS}
    for conv, r in got.items():
        rows = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(t[2] or "", t[3] or "") for t in rows]
        assert r["n_turns"] == len(rows)
        assert r["loss"] == "".join(t[3] or "" for t in rows if t[2] == "assistant")
        assert r["formatted"].count("<|turn|>") == r["formatted"].count("<|end|>") == len(rows)
    assert formatted(spark, []).count() == 0


def test_parts_become_placeholders(spark):
    parts = [
        ("text", "look <", None, None, None, None, None), ("image", None, "a.png", 56, 57, None, None), ("audio", None, "b.wav", None, None, 2.01, None),
        ("text", " and ", None, None, None, None, None), ("document", None, None, None, None, None, 3), ("image", None, None, None, None, None, None),
        (None, "plain", None, None, None, None, None), ("video", "as text", "c", None, None, None, None),
    ]
    data = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    (row,) = chat.format_chat(data).collect()
    assert row["formatted"] == "<|turn|>user<|body|>look <~<|image|><|audio|> and <|document|><|image|>plainas text<|end|><|turn|>assistant<|body|><|end|>"
    assert [tuple(a) for a in row["attachments"]] == [("image", "a.png", 6), ("audio", "b.wav", 51), ("document", None, 768), ("image", None, 1)]
    assert [tuple(s) for s in row["loss_spans"]] == [(row["formatted"].rindex("<|end|>") + 1, 0)]


ROWS = (
    [(i, prose(i, 20 + i % 7), "en", "big") for i in range(60)] + [(100 + i, prose(i, 15), "en", "a") for i in range(3)]
    + [(200, prose(1, 3_000), None, "long"), (201, None, None, "long"), (202, "", None, "empty"), (203, None, None, "none")]
    + [(300, prose(4, 30), None, None), (None, prose(5, 12), None, None), (301, "tie tie", None, "É"), (301, "tie tie", None, "É"), (301, "tie too", None, "É")]
)


def wanted_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    limited, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in limited]
        level = (total - sum(limited.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return {**{s: level * weight[s] for s in free}, **limited}
        limited.update({s: 3 * sizes[s] for s in over})


def test_mix(spark):
    docs = documents(spark, ROWS).withColumnRenamed("row", "source_nr")
    found = mixing.taken_words(docs, block_words=64).collect()
    sizes = {}
    for _, text, _, source in ROWS:
        sizes[source] = sizes.get(source, 0) + len(blank_words(text))
    targets = wanted_targets(sizes)
    assert len(found) == len(ROWS)
    for source, target in targets.items():
        own = [r for r in found if r["source"] == source]
        assert all(r["target"] == pytest.approx(target) and r["source_size"] == sizes[source] for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= 1
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
        assert max(r["taken"] // r["size"] for r in own if r["size"]) - min(-(-r["taken"] // r["size"]) for r in own if r["size"]) <= 1 if target else True
    again = mixing.taken_words(docs.repartition(7), block_words=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_pieces_tile_the_slots(spark):
    docs = documents(spark, ROWS)
    lines, pieces = mixing.mix(docs, block_words=64)
    goals = {r["source_nr"]: r["goal"] for r in lines.select("source_nr", "goal").distinct().collect()}
    rows = pieces.collect()
    for nr, goal in goals.items():
        own = [r for r in rows if r["source_nr"] == nr]
        assert sum(r["words"] for r in own) == goal and all(r["words"] > 0 for r in own)
        slots = {r["slot"] for r in own}
        per_slot = [sum(r["words"] for r in own if r["slot"] == s) for s in slots]
        assert not slots or max(per_slot) - min(per_slot) <= 1  # equal blocks
    # low discrepancy: after any number of slots each source is near its share
    slots = sorted({(r["slot"], r["source_nr"]) for r in rows})
    total = sum(goals.values())
    assert len({s for s, _ in slots}) == len(slots)
    for n in range(10, len(slots), 5):
        for nr, goal in goals.items():
            assert abs(sum(1 for _, s in slots[:n] if s == nr) - n * goal / total) < 5


def test_mixed_documents(spark):
    docs = documents(spark, ROWS).withColumnRenamed("row", "copies")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[(r["doc_id"], r["text"])] = got.get((r["doc_id"], r["text"]), 0) + 1
    want = {}
    for r in mixing.taken_words(docs).collect():
        if r["taken"]:
            key = (r["doc_id"], r["size"])
            want[key] = want.get(key, 0) + r["copies"]
            assert r["copies"] >= -(-r["taken"] // r["size"])
    by_size = {}
    for (d, text), n in got.items():
        by_size[(d, len(blank_words(text)))] = by_size.get((d, len(blank_words(text))), 0) + n
    assert by_size == want
    assert mixing.taken_words(docs.where("false")).count() == 0
    assert mixing.mixed_documents(docs.where("false")).count() == 0


def test_digest_of_an_empty_loss(spark):
    (r,) = formatted(spark, [(1, 0, "user", "x")]).select(F.sha2(chat.loss_text(F.col("formatted"), F.col("loss_spans")), 256).alias("h")).collect()
    assert r["h"] == hashlib.sha256(b"").hexdigest()
