"""Lexical search, clustering and fingerprints against plain Python."""

import random
from collections import Counter
from math import floor, log

import numpy as np
import pytest
import xxhash

from panelweave.llm import clustering, lexical, queries, simhash
from tests.llm.helpers import blank_words, documents, plain_words, prose

SF = "/root/testdata/sf0.001"


def ranked(docs, items, k):
    """{item: [(doc_id, score)]} by the formula, document by document."""
    counts = [(d, Counter(plain_words(t))) for d, t in docs if d is not None and plain_words(t)]
    n_docs, n_words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(term for _, c in counts for term in c)
    out = {}
    for item, text in items:
        out.setdefault(item, set()).update(plain_words(text))
    found = {}
    for item, terms in out.items():
        scores = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // n_words
            score = sum(
                floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c
            )
            if score > 0:
                scores.append((-score, d))
        found[item] = [(d, -s) for s, d in sorted(scores)[:k]]
    return {i: f for i, f in found.items() if f}


def searched(spark, docs, items, **options):
    rows = spark.createDataFrame(items, "item_id long, text string, score long, rank int")
    got = {}
    for r in sorted(lexical.search(documents(spark, docs), rows, **options).collect(), key=lambda r: (r["item_id"], r["rank"])):
        got.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(got[r["item_id"]])
    return got


@pytest.mark.parametrize("block_docs, terms_at_once", [(2048, 1_000_000), (3, 40)])
def test_search_equals_the_formula(spark, monkeypatch, block_docs, terms_at_once):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 400)
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices([f"t{j}" for j in range(60)], weights=[1 / (j + 1) for j in range(60)], k=rng.choice([1, 3, 20, 20, 20, 90])))) for i in range(300)]
    docs += [(400 + i, "Same Same text, here") for i in range(40)]  # ties
    docs += [(500, None), (501, ""), (502, "---"), (None, "t1 t2"), (503, "t1 " * 30_000), (504, "É" + "x" * 100_000), (505, prose(1, 40_000))]
    items = [(1, "T1 t2 t2 t59"), (2, "same here"), (3, None), (4, "?"), (5, "nowhere"), (6, " ".join(f"t{j}" for j in range(60))), (1, "t7"), (7, "é")]
    items = [(*i, 1, 2) for i in items] + [(None, "t1", 1, 2)]
    for k in (7,):
        want = ranked(docs, [i[:2] for i in items if i[0] is not None], k)
        assert searched(spark, docs, items, k=k, block_docs=block_docs, terms_at_once=terms_at_once) == want


def test_search_without_rows(spark):
    assert searched(spark, [], [(1, "a", 0, 0)]) == {}
    assert searched(spark, [(1, "a b")], []) == {}
    assert searched(spark, [(1, None)], [(1, "a", 0, 0)]) == {}


def test_search_keeps_repeated_rows_and_ranges(spark):
    assert [d for d, _ in searched(spark, [(1, "a b"), (1, "a b"), (2, "c")], [(9, "a", 0, 0)])[9]] == [1, 1]
    which, numbers = lexical._ranges(np.array([3, 5, 5]), np.array([5, 5, 7]))
    assert which.tolist() == [0, 0, 2, 2] and numbers.tolist() == [3, 4, 5, 6]


def lloyd(rows, k, rounds):
    """{vec_id: (cluster, distance)} and centroids, trying every centroid."""
    import hashlib

    exact = [(i, [int(v.as_integer_ratio()[0] * 256 // v.as_integer_ratio()[1]) for v in x]) for i, x in rows]
    first = sorted(exact, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [x for _, x in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        of = [nearest(x)[1] for _, x in exact]
        for n in range(len(centres)):
            own = [x for (_, x), c in zip(exact, of) if c == n]
            if own:
                centres[n] = [sum(column) // len(own) for column in zip(*own)]
    return sorted((i, nearest(x)[1], min(nearest(x)[0], 2**63 - 1)) for i, x in exact), centres


def vectors(spark, rows):
    full = [(i, x, 3, 4) for i, x in rows]
    return spark.createDataFrame(full, "`v.id` long, `e.x` array<double>, cluster int, inertia int")


def clusters(spark, rows, width, **options):
    found = clustering.cluster(vectors(spark, rows), width=width, vec_id="v.id", embedding="e.x", **options).collect()
    return sorted((r["vec_id"], r["cluster"], r["distance"]) for r in found), found


@pytest.mark.parametrize("scale_of", [1.0, 1.7e308])
def test_clusters_equal_a_full_search(spark, scale_of):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * scale_of for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(30)] + [(5, rows[5][1]), (6, rows[7][1])]  # ties and repeated ids
    junk = [(300, None), (301, [1.0]), (302, [1.0, None, 1.0, 1.0]), (303, [float("nan")] * 4), (304, [float("inf")] * 4), (None, [0.0] * 4)]
    want, centres = lloyd(rows, 12, 3)
    got, found = clusters(spark, rows + junk, 4, k=12, rounds=3)
    assert got == want
    of = Counter()
    for _, c, d in want:
        of[c] += d
    for r in found:
        assert r["cluster_inertia"] == min(of[r["cluster"]], 2**63 - 1) and r["inertia"] == min(sum(of.values()), 2**63 - 1)
        assert r["centroid_sha256"] == clustering.centroid_digest(centres[r["cluster"]])


def test_clusters_of_few_vectors(spark):
    assert clusters(spark, [], 2)[0] == []
    assert clusters(spark, [(1, [0.5, 0.5])], 2)[0] == [(1, 0, 0)]
    same = [(i, [0.25, -0.25]) for i in range(9)]
    assert {c for _, c, _ in clusters(spark, same, 2, k=3)[0]} == {0}  # equal centroids: the smallest number


def test_orchard_visits_few_centroids_and_ends_right():
    rng = np.random.default_rng(1)
    centres = clustering.Centroids(rng.integers(-500, 500, (40, 8)).tolist())
    x = rng.integers(-600, 600, (2000, 8))
    every = ((x[:, None, :] - np.array(centres.rows)) ** 2).sum(axis=2)
    for guess in (0, 2, 8):
        now, best = centres.nearest(x, guess=guess)
        assert (now == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()


def plain_print(text):
    words = blank_words(text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(prints, within=3):
    """Smallest id reachable; every pair is compared."""
    distinct = sorted(set(prints.values()))
    x = np.array(distinct, np.uint64)
    label = {p: i for i, p in sorted(prints.items(), reverse=True)}
    near = [x[np.bitwise_count(x ^ p) <= within].tolist() for p in x]
    changed = True
    while changed:
        changed = False
        for p, others in zip(distinct, near):
            least = min(label[int(q)] for q in others)
            for q in others:
                if label[int(q)] != least:
                    label[int(q)], changed = least, True
    return {i: label[p] for i, p in prints.items()}


def test_fingerprints_equal_the_plain_form(monkeypatch):
    texts = ["", None, "one", "One two", "a b c", "a  b\tc\nd", "É e É e", prose(1, 700), " x\x0by ", prose(2, 65), "no" * 5000, "\x1cx y\x1d z w"]
    for segment in (1 << 20, 7):
        monkeypatch.setattr(simhash, "SEGMENT", segment)
        for t in texts:
            p, n = simhash.fingerprint(None if t is None else t.encode())
            assert p % 2**64 == plain_print(t)
            assert n == (max(1, len(blank_words(t)) - 2) if blank_words(t) else 0)


def linked(spark, prints, **options):
    rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in prints.items()], "print long, node long")
    from pyspark.sql import functions as F

    classes = rows.groupBy("print").agg(F.min("node").alias("node"), F.count("*").alias("docs"))
    label = {r["node"]: r["label"] for r in simhash.link_fingerprints(classes, **options).collect()}
    head = {}
    for i, p in sorted(prints.items()):
        head.setdefault(p, i)
    return {i: label.get(head[p], head[p]) for i, p in prints.items()}


def flipped(rng, p, most):
    for b in rng.sample(range(64), rng.randrange(most + 1)):
        p ^= 1 << b
    return p


@pytest.mark.parametrize("parts, paired", [((2,), 64), ((6,), 2), (simhash.PARTS, 64)])
def test_links_equal_all_pairs(spark, parts, paired):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = dict(enumerate(base + [flipped(rng, rng.choice(base), 6) for _ in range(400)]))
    correlated = [(b & 0xFFFF) * 0x0001000100010001 for b in base]  # parts that say the same
    prints |= {1000 + i: p for i, p in enumerate(correlated + [flipped(rng, rng.choice(correlated), 4) for _ in range(200)])}
    prints |= {2000 + i: 0 for i in range(5)}
    assert linked(spark, prints, parts=parts, paired=paired) == components(prints)


@pytest.mark.parametrize("within", [1, 3])
def test_a_crowded_ball_is_linked_by_hubs(spark, within):
    rng = random.Random(within)
    middle = rng.getrandbits(64)
    low = [middle ^ sum(1 << b for b in rng.sample(range(20), rng.randrange(8))) for _ in range(300)]
    chain = [middle ^ ((1 << (3 * i)) - 1) << 20 for i in range(14)]
    prints = dict(enumerate(low + chain))
    assert linked(spark, prints, within=within, paired=4) == components(prints, within)


def test_documents_of_all_kinds(spark):
    long_text = prose(7, 60_000)
    texts = [
        (1, None), (2, ""), (3, "   "), (4, prose(1, 300)), (5, prose(1, 300) + " more"), (6, prose(2, 300)), (7, prose(1, 300)), (None, prose(1, 300)),
        (8, "x"), (9, "X"), (10, long_text), (11, long_text + " end"), (12, "y" * 3_000_000), (13, prose(3, 80)), (13, prose(4, 80)), (14, prose(4, 80)), (15, prose(3, 80)),
    ]
    rows = simhash.near_duplicates(documents(spark, texts)).collect()
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == len(texts) and got[None] is None
    assert got[1] == got[2] == got[3] == 1 and got[7] == 4 and got[9] == got[8] == 8 and got[11] == got[10] == 10 and got[12] == 12 and got[6] == 6
    assert got[13] == got[14] == got[15] == 13  # both texts of 13 link it
    assert simhash.near_duplicates(documents(spark, [])).collect() == []


def test_fingerprint_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    prints = {r["doc_id"]: plain_print(r["text"]) for r in docs}
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op13_pigeonhole_simhash"](spark, SF).collect()}
    label = components(prints)
    assert found == {d: (f"{p:016x}", label[d]) for d, p in prints.items()}
