"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Observation, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

HEADLINE = [
    "column_diff",
    "classify_single",
    "drift_counters",
    "history_counters",
    "top_event_per_table",
    "impact_summary",
    "column_edges",
    "policy_decisions",
    "rate_limited_decisions",
    "cdc_events",
    "payload_schema",
    "dashboard_refs",
    "recall_precision",
    "daily_revenue",
    "classify_batch",
    "node_closure",
    "widened_columns",
    "alert_fields",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shiftlens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from shiftlens.plans.registry import QUERIES

    names = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()  # session start is not measured
    QUERIES["column_diff"](spark, folder).write.format("noop").mode("overwrite").save()  # nor is the first compilation
    times, rates = {}, {}
    for name in names:
        start = time.perf_counter()
        result = QUERIES[name](spark, folder)
        seen = Observation()
        result.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        rates[name] = round(seen.get["rows"] / times[name])
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "rows_per_sec": rates, "sf": float(scale)}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
