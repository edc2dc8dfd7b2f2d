"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from verification.spark_queries import QUERIES

from tests.session import local_session

HEADLINE = [
    "learned_profile", "compliance_summary", "compliance_by_folder", "drift_summary", "ai_confidence",
    "ai_indicators", "audit_score", "analysis_merged", "debounce_sessions", "violation_trend", "ai_files_ranked",
    "analysis_log", "recent_violations", "stream_monitor",
]


def calibration() -> float:
    """Seconds of a fixed loop, to compare machines between rounds."""
    start = time.time()
    sum(k * k % 7 for k in range(20_000_000))
    return round(time.time() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8)))
    seconds = {}
    for name in HEADLINE:
        # the second run counts, so that a query's place in the list does not matter
        for _ in range(2):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "calibration_sec": calibration(), "sf": os.path.basename(sf_dir.rstrip("/")),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
