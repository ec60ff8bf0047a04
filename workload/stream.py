"""Streaming runs over the given tables as arriving files, read back from where they were written."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldmill.catalogue import Catalogue
from fieldmill.sources.versions import versions
from fieldmill.streaming import jobs as S
from workload.process import SHOWN, SHOWN_SQL, run_sql
from workload.registry import Tables, new_folder, query
from workload.review import _LATEST


def _arriving(t: Tables, name: str) -> DataFrame:
    return (t.spark.readStream.schema(getattr(t, name).schema).option("pathGlobFilter", f"{name}.parquet")
            .parquet(t.folder))


def _through(t: Tables, stream: DataFrame) -> DataFrame:
    root = new_folder(t)
    S.run_available(stream, "parquet", f"{root}/state", f"{root}/out")
    return t.spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("stream_extract", run_sql("(SELECT doc_id, text, 'plain_text' AS parser_type FROM documents)") + SHOWN_SQL)
def stream_extract(t: Tables):
    docs = _arriving(t, "documents").select(
        "doc_id", F.col("text").alias("raw_text"), F.lit("plain_text").alias("parser_type"),
        F.lit("auto_detect").alias("extraction_mode"), F.lit(None).cast("string").alias("document_type_key"))
    return _through(t, S.extract_stream(docs, Catalogue.bundled()).select(*SHOWN))


@query("stream_quota_counts", """
SELECT 'p' || (user_id % 2) AS provider, 'm1' AS model, <<show:date_trunc('minute', ts)>> AS window_start, count(*) AS request_count, 0 AS late_requests,
  date_trunc('minute', ts) + INTERVAL 1 MINUTE > (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) AS is_open
FROM events WHERE ts IS NOT NULL GROUP BY user_id % 2, date_trunc('minute', ts)""")
def stream_quota_counts(t: Tables):
    requests = _arriving(t, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.lit("m1").alias("model"),
        F.concat(F.lit("p"), (F.col("user_id") % 2).cast("string")).alias("provider"))
    root = new_folder(t)
    S.run_available(requests, "", f"{root}/state", writer=S.append_counts(f"{root}/counts"))
    return S.read_counts(t.spark, f"{root}/counts").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("stream_dedup", "SELECT DISTINCT sha256(props) AS content_hash FROM events")
def stream_dedup(t: Tables):
    copies = _arriving(t, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.sha2("props", 256).alias("content_hash"))
    root = new_folder(t)
    S.run_available(copies, "", f"{root}/state", writer=S.append_new_content(f"{root}/contents"))
    return versions(t.spark, f"{root}/contents").select("content_hash")


@query("stream_latest_value", f"SELECT field_id, lastv AS corrected_value FROM {_LATEST} l")
def stream_latest_value(t: Tables):
    root = new_folder(t)
    log = _arriving(t, "events").select(
        F.col("event_id").alias("correction_id"), ((F.col("event_id") * 31) % 6007).alias("field_id"),
        F.col("ts").cast("timestamp").alias("corrected_at"), F.expr(
            "CASE event_id % 5 WHEN 0 THEN 'INV-' || CAST(floor((event_id * 31) % 6007 / 6) AS BIGINT) "
            "WHEN 1 THEN '  inv-' || CAST(floor((event_id * 31) % 6007 / 6) AS BIGINT) WHEN 2 THEN '' "
            "WHEN 3 THEN 'Supplier ' || user_id ELSE 'Changed ' || event_id END").alias("corrected_value"))
    S.run_available(log, "", f"{root}/state", writer=S.keep_latest(f"{root}/latest"))
    return S.read_latest(t.spark, f"{root}/latest").select("field_id", "corrected_value")
