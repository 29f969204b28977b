"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to completion with the ``noop`` sink (full computation, nothing
collected to the driver). Queries run once to warm the JVM on the smallest table set,
then once timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "stories_narrative", "stories_orders", "stories_bullets", "prefix_pieces", "case_metadata",
    "event_order", "token_replace", "stratified_kfold", "metrics_macro", "roc_auc",
    "class_weights_balanced", "focal_loss_mean",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from casestory.plans import catalog
    from casestory.session import get_spark
    spark = get_spark(cpus=cpus, shuffle_partitions=max(8, cpus * 2), app="casestory-bench")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
             if n in catalog.QUERIES]
    extra = [n for n in HEADLINE if n not in catalog.QUERIES]
    # warm-up on the smallest data
    warm = "/root/testdata/sf0.001"
    for n in names[:3]:
        catalog.QUERIES[n][0](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.time()
        catalog.QUERIES[n][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    sf = sf_dir.rstrip("/").split("sf")[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "missing": extra}))


if __name__ == "__main__":
    main()
