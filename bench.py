"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query is run to the end through the
``noop`` sink, after one untimed warm-up query that starts the executor.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tracelight.plans.catalogue import PARTITIONS_CONF, QUERIES

HEADLINE = [
    "detect_tables",
    "detect_values",
    "resolve_conflicts",
    "classify_fields",
    "classify_findings",
    "infer_schema",
    "flatten_json_fields",
    "detect_messages",
    "analyze_messages",
    "find_spans",
    "redact_text",
    "sample_percentage",
    "failure_streaks",
    "build_prompts",
    "stream_detect",
    "stream_classify",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tracelight-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        # each test table is one row group, which one task would read
        .config(PARTITIONS_CONF, cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["detect_dates"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
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
