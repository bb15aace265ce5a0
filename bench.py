"""Time the headline queries; prints one JSON line.

Each query runs once to warm up, then three times into a no-op sink; the median
counts.  BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from checks import registry
from checks.compare import session

HEADLINES = [
    "bloc_panel",
    "label_lookup_fallback",
    "agg_votes_by_bloc",
    "panel_widen_votes",
    "panel_widen_features",
    "previous_elections",
    "asof_backfill",
    "rank_pct",
    "feature_winsor",
    "augmented_features",
    "global_dataset",
    "median_impute",
    "mi_binned",
    "train_test_split",
    "permutation_importance_linear",
    "permutation_importance",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    registry.load()
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in HEADLINES:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
