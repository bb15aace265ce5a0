"""Components at the limits of doubles, and names that need quotes."""

from math import floor

from panelweave.llm import topk


def test_largest_components_and_quoted_names(spark):
    rows = [(0, [1.7e308, 0.5]), (100, [1.0, -2.5]), (1, [-1.7e308, 1.0]), (2, [1e300, 2.0]), (3, [0.25, 0.001]), (4, [float("inf"), 1.0]), (5, None)]
    df = spark.createDataFrame(rows, "`vec.id` long, `e.x` array<double>")
    found = topk.top_k(df.where("`vec.id` % 100 = 0"), df, k=3, vec_id="vec.id", embedding="e.x").collect()
    whole = {i: [floor(v * 1024) if abs(v) < 1e300 else int(v) * 1024 for v in x] for i, x in rows if i not in (4, 5)}
    for q in (0, 100):
        scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], x)))), i) for i, x in whole.items() if i != q]
        got = [(-r["score"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert got == sorted(scores)[:3]
