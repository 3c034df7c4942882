"""Seconds per headline query; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from fleetlens.sources.workspace import ensure_shared
from verification.queries import QUERIES

HEADLINE = [
    "top_queries", "statement_stats", "query_stats_delta", "fingerprint_rollup", "database_delta",
    "pooler_delta", "table_delta", "index_delta", "index_stats", "bloat_report", "cache_hit_rates",
    "fn_obfuscate_query", "fn_fingerprint", "fn_parse_comment", "log_stitch", "log_metrics",
    "slow_query_report", "explain_throttle", "collector_log_stats", "metric_stream", "metric_series",
    "schema_health", "error_cap", "report_document", "stream_logs",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_shared(spark)
    names = os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split()
    # One small run starts the JIT and the Python side.
    QUERIES["statement_stats"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
