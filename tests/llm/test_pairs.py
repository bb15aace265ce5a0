import itertools
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelweave.llm import linededup, neardup, passages, topk
from panelweave.llm.components import connected_components
from tests.llm.helpers import blank_words, documents, prose


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(30)] + [(7, 7)]
    links += [(1000, 1000 + i) for i in range(1, 300)]
    rng.shuffle(links)
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == components(nodes, [x for x in links if x[0] != x[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(f"new{rng.randrange(10**9)}" if rng.random() < share else w for w in text.split())


def shingle_set(text, width):
    w = blank_words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def near_docs():
    hub = prose(0, 120)
    rows = [(1000 + i, edited(hub, 0.005 * (i % 12), i)) for i in range(60)]  # a group around one text, many just below the limit
    rows += [(500, hub), (400, hub.upper()), (401, hub)]
    step = prose(1, 150)
    for i in range(8):  # a chain of which only neighbours are linked
        step = edited(step, 0.02, 50 + i)
        rows.append((200 + i, step))
    rows += [(i, prose(100 + i, 80)) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \n"), (53, "one two"), (54, "One  two"), (55, "one"), (None, hub), (None, None), (56, prose(7, 20_000)), (57, prose(7, 20_000) + " x")]
    rows += [(60, "same row a b c d"), (60, "same row a b c d"), (61, "two texts of one id"), (61, "same row a b c d")]
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, width):
    rows = near_docs()
    sets = [(d, shingle_set(t, width)) for d, t in rows]
    keyed = [(d, s) for d, s in sets if s and d is not None]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(keyed, 2) if a != b and 100 * len(x & y) >= 80 * len(x | y)]
    want = components({d for d, _ in rows if d is not None}, links)
    got = neardup.near_duplicates(documents(spark, rows), width=width).collect()
    key = lambda x: (str(x[0]), x[1], str(x[2]))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(
        ((d, len(s), want.get(d)) for d, s in sets), key=key
    )


def test_one_of_each(spark):
    docs = documents(spark, near_docs()).withColumnRenamed("row", "component_id").withColumnRenamed("size", "gone")
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 2 and {50, 51, 52, 53, 55, 56} <= set(ids) and 54 not in ids and 57 not in ids and 401 not in ids
    assert neardup.one_of_each(docs.where("false")).count() == 0


def removed_lines(rows, window):
    texts = [(d, t.split("\n")) for d, t in rows if t is not None and d is not None]
    first = {}
    places = sorted((d, s, tuple(lines[s : s + window])) for d, lines in texts for s in range(len(lines) - window + 1))
    again = defaultdict(set)
    for d, s, win in places:
        if first.setdefault(win, (d, s)) != (d, s):
            again[d] |= set(range(s, s + window))
    return again


def line_docs():
    rng = random.Random(5)
    block = "\n".join(prose(i, 5) for i in range(6))
    rows = [(i, "\n".join([*(prose(100 + 7 * i + j, 4) for j in range(rng.randrange(4))), block, prose(i, 3), "menu", "menu"])) for i in range(20)]
    rows += [(30, None), (31, ""), (32, "menu"), (33, "a\na\na\na\na"), (34, block.replace("\n", "\r\n")), (None, block), (35, block), (35, block), (36, "\n".join(["x", block] * 400))]
    return rows


def test_line_runs(spark):
    rows = line_docs()
    docs = documents(spark, rows).withColumnRenamed("row", "n_lines").withColumnRenamed("size", "start")
    again = removed_lines(rows, 3)
    want = []
    for d, t in rows:
        lines = [] if t is None else t.split("\n")
        left = [x for i, x in enumerate(lines) if d is None or i not in again[d]]
        want.append((str(d), None if t is None else "\n".join(left), len(lines), len(lines) - len(left)))
    out = linededup.without_repeated_runs(docs)
    assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    assert sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_removed"]) for r in out.collect() if r["text"] is not None) == sorted(w for w in want if w[1] is not None)
    assert linededup.without_repeated_runs(docs.where("false")).count() == 0


def test_short_line_runs(spark):
    long, half, other = prose(1, 60), prose(2, 30), prose(3, 30)
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd\n{half}\n{other}"), (3, f"{half}\n{other}\ne"), (4, half), (5, "two\nlines"), (6, "two\nlines"), (7, half), (8, f"f\n{half}\ng"), (9, ""), (10, ""), (11, "two")]
    left = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.without_repeated_runs(documents(spark, rows)).collect()}
    want = {d: (t, 0) for d, t in rows} | {2: (f"c\nd\n{half}\n{other}", 1), 3: ("e", 2), 6: ("", 2), 7: ("", 1)}
    assert left == want


def test_rows_that_share_an_id_lose_their_own_lines_only(spark):
    block = "one\ntwo\nthree"
    rows = [(1, block), (2, f"{block}\nx"), (2, "a\nb\nc\nd"), (3, "p\n" * 2000)]
    left = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in linededup.without_repeated_runs(documents(spark, rows)).collect())
    assert left == [(1, block, 0), (2, "a\nb\nc\nd", 0), (2, "x", 3), (3, "p\n", 1999)]


def test_positions_are_fewer_than_windows(spark):
    rows = [(i, "\n".join(prose(1000 * i + j, 3) for j in range(200))) for i in range(5)]
    docs = documents(spark, rows)
    found = linededup.selected_positions(docs, "text", "doc_id", 3, None)
    places = [(r["doc_id"], r["position"]) for r in found.collect()]
    assert len(places) == len(set(places)) < 0.6 * 5 * 198
    assert found.agg(F.sum(F.size("windows"))).first()[0] == 5 * 198


def test_windows_cover_each_subsequence_once():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 10**9, 60)
    found = passages.compact_windows(values, 7)
    for i, j in itertools.combinations(range(60), 2):
        hits = [c for left, c, right in found if left <= i <= c <= j <= right]
        assert len(hits) == 1 or (not hits and j - i + 1 < 7)
        if hits:
            assert values[hits[0]] == values[i : j + 1].min()


def test_repeated_passages(spark):
    shared, near = prose(1, 60, "s"), prose(2, 80, "n")
    rows = [(i, f"{prose(100 + i, 90)} {shared} {prose(200 + i, 30)}") for i in range(5)]
    rows += [(10 + i, f"{prose(300 + i, 40)} {edited(near, 0.02 * (i > 0), i)} {prose(400 + i, 70)}") for i in range(3)]
    rows += [(20 + i, prose(500 + i, 200)) for i in range(5)]
    rows += [(30, None), (31, ""), (32, "few words"), (None, rows[0][1]), (40, rows[20][1] if len(rows) > 20 else prose(500, 200)), (41, prose(9, 45)), (42, prose(9, 45))]
    rows += [(50, prose(60, 10_000) + " " + shared), (51, prose(61, 70)), (51, prose(61, 70))]
    found = {(r["doc_id"], r["n_words"]): r for r in passages.passage_classes(documents(spark, rows)).collect()}
    of = {d: r for (d, _), r in found.items()}
    assert {of[i]["class_id"] for i in (0, 1, 2, 3, 4, 50)} == {0}
    assert all(60 <= of[i]["n_repeated"] <= 62 for i in (0, 1, 2, 3, 4, 50))
    assert {of[i]["class_id"] for i in (10, 11, 12)} == {10}
    assert of[40]["class_id"] == 20 and of[40]["n_repeated"] == of[20]["n_repeated"] == 200
    for d in (21, 22, 23, 24, 30, 31, 32, 41, 42):
        assert of[d]["class_id"] == d and of[d]["n_repeated"] == 0
    assert of[None]["class_id"] is None
    assert passages.passage_classes(documents(spark, [])).count() == 0


def test_passages_against_brute_force(spark):
    """Every exact run of 50 words that two documents share is found, and only near copies beside."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = {r["doc_id"]: r for r in passages.passage_classes(docs).collect()}
    first, links = {}, []
    for r in docs.orderBy("doc_id").collect():
        w = blank_words(r["text"])
        for i in range(len(w) - 49):
            other = first.setdefault(tuple(w[i : i + 50]), r["doc_id"])
            if other != r["doc_id"]:
                links.append((other, r["doc_id"]))
    for a, b in links:
        assert found[a]["class_id"] == found[b]["class_id"] and found[a]["n_repeated"] >= 50 and found[b]["n_repeated"] >= 50


def same_class(found, pairs):
    return sum(found[a]["class_id"] == found[b]["class_id"] for a, b in pairs)


def test_passages_around_a_frequent_phrase(spark):
    """Pairs of passages whose signatures all texts share, by a phrase too short for a passage."""
    phrase = prose(70, 44, "p")
    rows = []
    for i in range(60):
        more = prose(1000 + i, 14, "m")
        rows += [(1 + 2 * i + j, f"{prose(2000 + 2 * i + j, 60, 'x')} {phrase} {more} {prose(3000 + 2 * i + j, 60, 'y')}") for j in range(2)]
    random.Random(3).shuffle(rows)
    found = {r["doc_id"]: r for r in passages.passage_classes(documents(spark, rows)).collect()}
    assert same_class(found, [(1 + 2 * i, 2 + 2 * i) for i in range(60)]) == 60
    assert all(r["n_repeated"] >= 50 for r in found.values())


def test_a_frequent_line_makes_few_pairs(spark, monkeypatch):
    """Texts that share no more than a line are told apart without their whole texts."""
    line, counts, stage = prose(80, 13, "l"), [], passages.stage
    rows = [(i, f"{prose(100 + i, 40, f'x{i}-')} {line} {prose(9000 + i, 40, f'y{i}-')}") for i in range(1500)]

    def counted(df, name):
        out = stage(df, name)
        if name == "candidates":
            counts.append(out.count())
        return out

    monkeypatch.setattr(passages, "stage", counted)
    found = passages.passage_classes(documents(spark, rows)).collect()
    assert len({r["class_id"] for r in found}) == 1500 and not any(r["n_repeated"] for r in found)
    assert sum(counts) < 750


def passages_at_the_limit(count):
    """Pairs of passages with one word changed in the middle, 0.80 to 0.90 alike as sets of five-word tokens."""
    rng, rows, alike = random.Random(11), [], []
    for i in range(count):
        words = prose(5000 + i, 51 + i % 45, f"q{i}-").split()
        other = list(words)
        other[len(words) // 2] = f"changed{i}"
        x, y = (shingle_set(" ".join(w), 5) for w in (words, other))
        alike.append(len(x & y) / len(x | y))
        for j, w in enumerate((words, other)):
            rows.append((2 * i + j, f"{prose(7000 + 2 * i + j, rng.randrange(30, 60), f'x{i}-{j}-')} {' '.join(w)} {prose(9000 + 2 * i + j, rng.randrange(30, 60), f'y{i}-{j}-')}"))
    return rows, alike


def test_passages_at_the_limit(spark):
    rows, alike = passages_at_the_limit(400)
    assert all(0.8 <= x <= 0.9 for x in alike)
    found = {r["doc_id"]: r for r in passages.passage_classes(documents(spark, rows)).collect()}
    assert same_class(found, [(2 * i, 2 * i + 1) for i in range(400)]) >= 395
    assert len({r["class_id"] for r in found.values()}) >= 400


def test_a_hot_passage_is_dealt_in_proportion(spark, monkeypatch):
    """Of a passage that most texts hold, a few cut ones meet the others; the others do not meet each other."""
    passage, sent, places = prose(90, 64, "h"), [], []
    rows = [(i, f"{prose(100 + i, 50, f'x{i}-')} {passage} {prose(9000 + i, 50, f'y{i}-')}") for i in range(600)]
    rows += [(1000 + i, f"{prose(20_000 + i, 50, f'u{i}-')} {' '.join(passage.split()[:40])} {prose(30_000 + i, 50, f'v{i}-')}") for i in range(8)]
    frame, stage = type(spark.range(0)), passages.stage
    run = frame.mapInArrow

    def counted(df, *args, **options):
        kinds = dict(df.dtypes)
        if kinds.get("covered") in ("boolean", "array<boolean>") and kinds.get("tokens") in ("binary", "array<binary>") and kinds.get("key") != "array<bigint>":
            sent.append(df.count() if kinds["tokens"] == "binary" else df.agg(F.sum(F.size("tokens"))).first()[0])
        return run(df, *args, **options)

    def kept(df, name):
        out = stage(df, name)
        if name == "places":
            places.append(out.agg(F.sum(F.size("key"))).first()[0])
        return out

    for name in ("SALTED", "BLOCK"):
        monkeypatch.setattr(passages, name, 32, raising=False)
    monkeypatch.setattr(frame, "mapInArrow", counted)
    monkeypatch.setattr(passages, "stage", kept)
    found = {r["doc_id"]: r for r in passages.passage_classes(documents(spark, rows)).collect()}
    assert all(found[i]["class_id"] == 0 and found[i]["n_repeated"] >= 64 for i in range(600))
    assert all(found[i]["class_id"] == i and not found[i]["n_repeated"] for i in range(1000, 1008))
    assert len(places) == len(sent) == 1 and 600 < places[0] and sent[0] <= 4 * places[0]


def some_places(seed, count, values, node=lambda i: i):
    """Rows node, label, covered, contexts, with common runs and repeated tokens."""
    rng = np.random.default_rng(seed)
    common = rng.integers(1, 60_000, 200).astype(np.uint16)
    contexts = rng.integers(1, values, (count, 93)).astype(np.uint16)
    for i in range(count):
        at, many, shift = rng.integers(0, 60), rng.integers(5, 93), rng.integers(-20, 21)
        part = common[max(0, 60 + at + shift) :][: min(many, 93 - at)]
        contexts[i, at : at + len(part)] = part
        if i % 3 == 0:
            contexts[i, : rng.integers(0, 40)] = 0
        if i % 5 == 0:
            contexts[i, rng.integers(30, 50) : rng.integers(50, 93)] = 7
    return np.array([node(i) for i in range(count)]), rng.integers(0, 4, count), rng.random(count) < 0.5, contexts


def pairs_one_by_one(x, y):
    found = set()
    for (n, k, c, around), (m, kk, cc, near) in itertools.product(zip(*x), zip(*y)):
        if n != m and not (k == kk and c and cc):
            both = (around, near) if n < m else (near, around)
            if passages._begins(both[0][None], both[1][None], 46, 15)[0]:
                found.add((min(n, m), max(n, m)))
    return found


def test_places_are_told_apart_by_bits_as_by_each_pair():
    for seed, values in ((1, 60_000), (2, 9)):
        x = some_places(seed, 60, values)
        y = some_places(seed, 90, values, lambda i: (i * 37) % 100)
        expected = pairs_one_by_one(x, y)
        assert expected and {tuple(p) for p in passages._alike(x, y, 46, 15).T.tolist()} == expected


def test_cells_may_end_in_any_batch(monkeypatch):
    rows, expected = [], set()
    for key, (own, other) in enumerate([(3, 0), (30, 50), (2, 3), (0, 5), (40, 0), (12, 12)]):
        sides = [some_places(10 * key + n, many, 60_000, lambda i, n=n: 1000 * key + 2 * i + n) for n, many in enumerate((own, other))]
        inner = key != 5
        for x, y in [(sides[0], sides[1])] + [(sides[0], sides[0])] * inner:
            expected |= pairs_one_by_one(x, y)
        for n, side in enumerate(sides):
            rows += [(key, 0, 1, n, inner, *(v.item() for v in row[:3]), row[3].tobytes()) for row in zip(*side)]
    # the tokens' bytes come last; small cells look at every pair
    names = ["key", "one", "two", "side", "inner", "node", "label", "covered", "tokens"]
    table = pa.table([list(c) for c in zip(*rows)], names=names)
    for size, at_once in ((1000, 1000), (7, 1000), (7, 8), (20, 11)):
        monkeypatch.setattr(passages, "AT_ONCE", at_once)
        out = [tuple(p.values()) for b in passages._meeting(46, 5)(table.to_batches(size)) for p in b.to_pylist()]
        within = {(a, b) for a, b in out if not (a % 2 == b % 2 == 1 and a // 1000 == b // 1000)}
        assert within == expected


def test_verification_in_parts(spark):
    passage = prose(91, 60, "z")
    rows = [(i, f"{prose(100 + i, 30, f'x{i}-')} {passage} {prose(9000 + i, 30, f'y{i}-')}") for i in range(12)]
    texts = spark.createDataFrame(rows, "node long, text string")
    pairs = spark.createDataFrame([(a, b) for a in range(12) for b in range(a + 1, 12)], "a long, b long")
    whole, parts = ({tuple(r) for r in passages._verified(texts, pairs, n, 5, 46, 0.8).collect()} for n in (1 << 30, 1000))
    assert whole == parts and len(whole) == 66


def vectors():
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(400)]
    rows += [(400, None), (500, [1.0, None]), (501, [float("nan")] * 8), (502, [float("inf")] * 8), (503, []), (600, [0.5]), (700, [0.0] * 8)]
    rows += [(800, rows[100][1]), (801, rows[100][1]), (801, rows[100][1]), (None, [1.0] * 8), (900, [0.1] * 10), (100, rows[100][1])]
    return rows


def scores(rows, scale=1024):
    ok = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, v in {i: v for i, v in ok if i % 100 == 0}.items():
        every = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)
        out[q] = [(i, -s) for s, i in every]
    return out


@pytest.mark.parametrize("block", [2048, 2])
def test_top_k(spark, block):
    rows = vectors()
    data = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(11)
    found = defaultdict(list)
    for r in topk.top_k(data.where("vec_id % 100 = 0"), data, query_block=block).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(found[r["query_id"]]) + 1
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert found == {q: s[:10] for q, s in scores(rows).items()}


def test_top_k_of_large_numbers_and_few_rows(spark):
    rows = [(0, [2.0**40 + 1, -(2.0**40)]), (1, [2.0**11, 2.0**11]), (2, [2.0**11 + 2, 2.0**11]), (3, [1e300, 0.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [(r["vec_id"], r["score"]) for r in topk.top_k(data.where("vec_id = 0"), data, scale=1.0).orderBy("rank").collect()]
    exact = {i: sum(int(a) * int(b) for a, b in zip(rows[0][1], v)) for i, v in rows[1:3]}
    assert found == [(3, 2**63 - 1), (2, exact[2]), (1, exact[1])]
    assert topk.top_k(data.where("false"), data).count() == 0
    assert topk.top_k(data.where("vec_id = 0"), data.where(F.lit(False))).count() == 0


def test_word_hashes_do_not_depend_on_the_place(monkeypatch):
    """Words longer than a segment included; the tables stay as long as a segment."""
    import numpy as np

    from panelweave.llm import common, shingles

    long_word = "ab" * 50
    text = f"  x {long_word} y{' ' * 40}{long_word} {'z' * 16} q {'z' * 16}q {long_word}c {'z' * 15} "
    monkeypatch.setattr(shingles, "SEGMENT", 16)
    common._kept().clear()
    words, hashes = text.split(), shingles.word_hashes(text.encode())
    assert len(words) == len(hashes)
    assert len({*zip(words, hashes.tolist())}) == len(set(words)) == len(set(hashes.tolist()))
    for w, h in zip(words, hashes):
        assert shingles.word_hashes(f" {w.upper()}\n".encode())[0] == h
    assert all(len(t) <= 256 for t in common._kept()["word hash tables", 16])
    common._kept().clear()
    assert np.array_equal(shingles.word_hashes(b"a bc"), np.concatenate([shingles.word_hashes(b"a"), shingles.word_hashes(b"bc")]))


def test_a_text_without_blanks_needs_little_memory():
    """50 MB in one word; what is kept afterwards does not grow with it."""
    import subprocess
    import sys

    code = """
import resource, sys
from panelweave.llm import common
from panelweave.llm.shingles import word_hashes
small = word_hashes(b"warm up")
text = b"x" * 50_000_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert len(word_hashes(text)) == 1 and len(word_hashes(text + b" y")) == 2
grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
kept = sum(t.nbytes for tables in common._kept().values() for t in tables)
assert grown < 250 and kept < 2_000_000, (grown, kept)
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
