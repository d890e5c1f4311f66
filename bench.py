"""Headline queries over one scale factor; prints one JSON line.

The canonical tables are ingested once (``prepare_tables``, one cold run) and the queries read
them, as in a running system. The total includes both.

Environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_REPS. Every result is written in full to the
``noop`` sink; the value of a query is the median over the repetitions after a warm-up run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "estimated_impact", "metrics_document", "weighted_scores", "swot", "match_competitors", "competitor_gaps",
    "heatmap_drivers", "dedup_tags", "customer_context", "link_reviews", "upsert_fill", "relative_spike", "stream_stats",
]


def main() -> None:
    from reviewatlas.plans import registry
    from reviewatlas.plans.fixtures import Tables
    from reviewatlas.plans.stored import StoredTables, write_canonical
    from reviewatlas.session import build_session, scratch_path

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = build_session("bench", cores)

    table = registry.load()
    store = scratch_path(spark, "bench")
    start = time.perf_counter()
    write_canonical(Tables(spark, sf_dir), store)
    timings = {"prepare_tables": round(time.perf_counter() - start, 3)}

    def run(name: str) -> float:
        start = time.perf_counter()
        table[name].build(StoredTables(spark, sf_dir, store)).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in HEADLINE:
        run(name)
        timings[name] = round(statistics.median(run(name) for _ in range(reps)), 3)
    print(json.dumps({
        "metric": "total seconds over headline queries, median of warm runs",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "cores": cores,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "driver_memory": spark.conf.get("spark.driver.memory"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
