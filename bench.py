"""Times the headline queries and prints one JSON line.

Every query is run BENCH_RUNS times (default 3) after one warm-up, its whole
result going to a sink that discards it; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stratamem import catalog  # noqa: E402
from stratamem.session import env_cpus, local_session  # noqa: E402

HEADLINE = [
    "knn_topk", "knn_layer_candidates", "doc_freq", "bm25_scores", "sparse_vector_norm", "combined_score",
    "retrieve_e2e", "retrieve_mmr", "gc_plan", "gc_stats", "gc_run_totals", "l1_last20", "session_counters",
    "latest_state_upsert", "task_list", "task_update", "skill_find_join", "sanitize", "char_windows",
    "md_sections", "html_sections", "recursive_chunks", "store_documents", "tokens_saved",
]


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    cpus = env_cpus()
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    seconds = {}
    for name in names:
        laps = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, base).write.format("noop").mode("overwrite").save()
            laps.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(laps[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "headline query seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(base.rstrip("/")), "cpus": cpus, "runs": runs,
    }))


if __name__ == "__main__":
    main()
