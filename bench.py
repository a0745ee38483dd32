"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the data, BENCH_CPUS the threads, BENCH_REPEATS the number of
timed runs after one warm-up; each query reports its median.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from framewitness.catalog.queries import QUERIES

HEADLINE = (
    "profile_nulls",
    "profile_unique",
    "profile_table_lineitem",
    "profile_table_events",
    "profile_table_docs",
    "check_duplicate_keys",
    "check_date_gaps",
    "cmp_numeric",
    "cmp_duplicates",
    "ev_baseline_totals",
    "route_issues",
    "evidence_ledger",
    "hypotheses",
    "findings_summary",
    "scan_blocked_terms",
    "validate_notes",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("framewitness-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeats + 1):
            start = time.perf_counter()
            # The noop sink runs the whole query, with every output column.
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
