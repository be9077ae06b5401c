"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query's full result is produced (written to Spark's ``noop`` sink). One untimed query warms the
session up; each query is then timed once.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans.registry import all_queries, runner  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = (
    "status_histogram", "top_hosts_over_time", "top_targets", "holdings_summary", "file_facets", "recent_activity_summary",
    "surt_keys", "scope_decisions", "longest_prefix", "effective_access", "address_location",
    "running_quota", "counter_increase", "low_activity_alerts",
    "closest_capture", "recently_seen", "revisit_records", "fetch_history", "content_changes", "merged_updates",
    "store_comparison", "storage_reconciliation", "newest_batches", "checkpoint_gaps",
    "documents_found", "hourly_launches", "page_texts", "term_index", "text_fingerprints", "near_copy_groups",
    "capture_index_batch", "crawl_log_lines",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else list(HEADLINE)
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    if names == ["all"]:
        names = [n for n in known]
    runner(known["status_histogram"])(spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.time()
        runner(known[name])(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
