import pytest

from panelweave.llm.decontaminate import find_contamination, without_contaminated
from tests.llm.helpers import documents, plain_words, prose

ITEM = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu!"
DOCS = [
    (1, f"before {ITEM} after {ITEM.upper()}"), (2, None), (3, ""), (4, "!!! ???"), (5, "tiny   ITEM here"), (5, "tiny item"),
    (6, prose(1, 20_000) + " été: " + ITEM.replace(" ", "\n--")), (None, "alpha beta gamma"), (7, "Ünder ONE two"),
]
ITEMS = [(10, ITEM), (2, ITEM), (3, "tiny item"), (4, None), (5, ""), (None, "one two"), (3, "tiny item")]


def brute(docs, items, width=10):
    windows = [(i, w[s : s + width]) for i, t in items for w in [plain_words(t)] for s in range(max(1, len(w) - width + 1)) if w]
    out = []
    for d, t in docs:
        words, hit, owners = plain_words(t), set(), set()
        for item, win in windows:
            for s in range(len(words) - len(win) + 1):
                if words[s : s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    owners |= {str(item)} if item is not None else set()
        out.append((d, len(words), len(hit), sorted(owners)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [8 << 20, 150])
def test_against_brute_force(spark, shard):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = find_contamination(documents(spark, DOCS), items, keep=["doc_id"], shard_bytes=shard).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["item_ids"])) for r in found), key=str) == brute(DOCS, ITEMS)
    texts = dict(DOCS)
    for r in found:
        if r["doc_id"] in (1, 6):
            for begin, end in r["spans"]:
                assert plain_words(texts[r["doc_id"]][begin:end]) == plain_words(ITEM)


def test_rows_keep_their_columns(spark):
    docs = documents(spark, DOCS).withColumnRenamed("row", "n_hit").withColumnRenamed("size", "_hits")
    left = without_contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["2", "3", "4", "None"]
    assert {r["n_hit"] for r in left.collect()} == {"own"}


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(documents(spark, []), items).count() == 0
    assert {r["n_hit"] for r in find_contamination(documents(spark, DOCS), items, keep=["doc_id"]).collect()} == {0}
