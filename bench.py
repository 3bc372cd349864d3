"""Headline-query timings.

Runs each headline query over $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS] and prints one JSON line. Each query is executed to
completion with the ``noop`` sink (every row computed, nothing collected),
after one warm-up pass over the sf0.001 tables ($BENCH_WARM_DIR).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pass_at_k", "error_counts", "error_frequency", "dedupe_keep_best", "rank_answers_runs",
    "filter_report", "time_stats", "all_pairs_runs", "curriculum_pairs_desc", "one_pair",
    "pvf_iter", "pvf_iter_type", "pvf_iter_priority", "replay_weights", "annotate",
    "truncate_at_stops", "entry_point", "stable_timing", "timeout_verdict", "stream_error_counts",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    from pairforge.plans.catalog import QUERIES
    from pairforge.session import get_session
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus))
    # Warm-up: each query once on the smallest tables (JVM JIT, codegen cache).
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in names:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
