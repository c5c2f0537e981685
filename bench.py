"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "threshold_sweep",
    "evaluation_report",
    "text_normalize",
    "tokenize_ngrams",
    "feature_projection",
    "composite_scores",
    "probability_safety",
    "sample_weights",
    "signal_feedback_apply",
    "profile_text_score",
    "signal_candidates",
    "multi_key_dedupe_join",
    "dedupe_keep_newest",
    "anti_join_trained",
    "best_per_key",
    "retention_candidates",
    "dedupe_ttl_refresh",
    "asof_freshness",
    "rolling_threshold_alert",
    "cooldown_suppress",
    "flipflop_suppress",
    "session_summary",
    "class_centroid",
    "group_vector_aggregate",
    "group_feature_rollup",
    "nested_json_flatten",
)


def main() -> None:
    from prefspark.plans import load_all
    from prefspark.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", cpus=os.environ.get("BENCH_CPUS", "8"))
    registry = load_all()
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the executors before the clock
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
