"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "processed_status", "process_documents", "process_structured", "deterministic_fields", "infer_template",
    "labelled_values", "line_table", "json_flatten", "records_to_fields", "schema_key_union", "template_order",
    "validate_fields", "field_decision", "document_status", "review_confidence", "apply_corrections",
    "refresh_status", "reviewer_briefing", "normalise_model_fields", "cache_lookup", "quota_admission",
    "search_documents", "document_view", "latest_action", "average_confidence", "backlog_totals",
    "content_duplicates", "stream_extract",
]


def session(cpus: str):
    from pyspark.sql import SparkSession
    return (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
            .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
            .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.session.timeZone", "UTC").getOrCreate())


def main() -> None:
    from workload.all import QUERIES
    from workload.registry import deal_out
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    deal_out(int(cpus) if cpus.isdigit() else 8)  # every test table is one file with one row group
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/orders.parquet").write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
