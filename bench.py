"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Arguments, if any, are the queries to run (``all`` for every
one). Each query runs ``BENCH_RUNS`` times (3), to a sink that throws the rows away, after one short warm-up job. ``queries`` and ``value`` are
medians; ``first`` is the first run of each query, which includes the start of workers and the making of code.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from workload import QUERIES

HEADLINE = [
    "j1_pending_queue", "t1_newest_pending", "j2_listing", "j3_digest_base", "j4_new_items", "j5_existing", "j6_now_enabled",
    "j7_digest_summaries", "a1_processing_stats", "a8_time_coded_parts", "a9_text_lengths", "a10_repeated_keys", "u2_import_feeds",
    "u3_insert_items", "u5_update_status", "u6_save_transcripts", "u9_violations", "w1_first_per_guid", "w2_latest_summaries",
    "f3_valid_feeds", "w3_positions", "w4_first_and_last", "w5_stage_runs", "x2_published_date", "x9_time_coded_text", "x11_markdown", "x12_chunks",
    "m1_apply_model", "m4_rule_summary", "s1_outline_rows", "s2_feed_items", "k1_outline_document", "p1_sync", "p2_status",
    "p3_weekly_html", "p4_import", "st1_sync_stream", "st3_live_status", "st4_weekly_completions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = HEADLINE if len(sys.argv) == 1 else list(QUERIES) if sys.argv[1:] == ["all"] else sys.argv[1:]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").write.format("noop").mode("overwrite").save()
    times, first = {}, {}
    for name in names:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "3"))):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name], first[name] = round(statistics.median(runs), 3), round(runs[0], 3)
    spark.stop()
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "first": first, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
