"""The same transforms on arriving data. Checkpoints go to the folder the session names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldmill.catalogue import Catalogue
from fieldmill.plans.process import field_rows, process_text
from fieldmill.sources import versions


def checkpoint_dir(spark: SparkSession, name: str, fallback: str | None = None) -> str:
    """`<spark.checkpoint.dir>/<name>`; ``fallback`` only where the cluster names none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{root.rstrip('/')}/{name}"


def extract_stream(documents: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Arriving free-text documents -> decided field rows. Stateless: one narrow stage."""
    return field_rows(process_text(documents, catalogue))


def quota_counts(requests: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Requests per provider, model and window; windows close when the watermark has passed them."""
    return (requests.withWatermark("ts", late)
            .groupBy(F.window("ts", width).alias("w"), "provider", "model")
            .agg(F.count(F.lit(1)).alias("request_count"))
            .select("provider", "model", F.col("w.start").alias("window_start"), "request_count"))


def append_counts(path: str, late: str = "10 minutes", width: str = "1 minute") -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of request counts per provider, model and window, of which none is held back or dropped.

    Each batch adds its own counts; a window's count is the sum over batches, so open windows can be read at any time and rows that
    come late still count. They are marked: is_late says that an earlier batch had seen a time later than the window's end by more
    than ``late``. Nothing is kept in state but the latest time of each batch.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        window = F.window("ts", width)
        counts = batch.where("ts is not null").groupBy("provider", "model", window.alias("w")).agg(
            F.count(F.lit(1)).alias("request_count"), F.max("ts").alias("latest"))
        counts = counts.select("provider", "model", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                               "request_count", "latest")
        before = versions.versions(spark, path, counts.withColumn("is_late", F.lit(False))).where(F.col("version") < number)
        seen = before.agg((F.max("latest") - F.expr(f"INTERVAL {late}")).alias("_closed")).first()["_closed"]
        closed = F.lit(False) if seen is None else F.col("window_end") <= F.lit(seen)
        versions.append(path, counts.withColumn("is_late", closed), number)
    return write


def read_counts(spark: SparkSession, path: str, late: str = "10 minutes") -> DataFrame:
    """provider, model, window_start, request_count (all rows), late_requests, is_open (more rows may come in time)."""
    every = versions.versions(spark, path)
    end = every.agg((F.max("latest") - F.expr(f"INTERVAL {late}")).alias("_closed"))
    sums = every.groupBy("provider", "model", "window_start", "window_end").agg(
        F.sum("request_count").alias("request_count"), F.sum(F.when(F.col("is_late"), F.col("request_count")).otherwise(0)).alias("late_requests"))
    seen = end.first()["_closed"]
    return sums.select("provider", "model", "window_start", "request_count", "late_requests",
                       (F.lit(True) if seen is None else F.col("window_end") > F.lit(seen)).alias("is_open"))


def first_of_content(documents: DataFrame, late: str) -> DataFrame:
    """Each content once, as long as copies arrive within ``late`` of each other."""
    return (documents.withWatermark("ts", late).dropDuplicatesWithinWatermark(["content_hash"]))


def append_new_content(path: str, key: str = "content_hash") -> Callable[[DataFrame, int], None]:
    """foreachBatch writer that keeps one row of every content, however long ago its first copy came.

    The streaming state is empty: what is known stands in the table. A batch is reduced to its own first rows, then freed from keys that
    earlier versions hold. Those are looked up with the batch as the small side, for which Spark builds a Bloom filter over the
    scan of the stored keys where that pays, so only keys that may be in the batch are shuffled.
    """
    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        stored = versions.versions(batch.sparkSession, path, fresh).where(F.col("version") < number)
        known = stored.select(key).join(fresh.select(key), key, "left_semi")
        versions.append(path, fresh.join(known, key, "left_anti"), number)
    return write


CORRECTED = ["corrected_at", "correction_id"]


def latest_values(corrections: DataFrame) -> DataFrame:
    """Latest correction per field."""
    return versions.latest(corrections.select("field_id", "corrected_value", *CORRECTED), "field_id", CORRECTED)


def keep_latest(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: the latest values of a batch become a version of the table at ``path``; earlier files stay untouched."""
    def write(batch: DataFrame, number: int) -> None:
        versions.append(path, latest_values(batch), number)
    return write


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """One row per field: the latest of all versions."""
    return latest_values(versions.versions(spark, path))


def compact_latest(spark: SparkSession, path: str, target: str) -> int:
    """The latest values as one version of a new table."""
    return versions.compact(spark, path, target, latest_values)


def run_available(stream: DataFrame, sink: str, checkpoint: str, path: str | None = None,
                  writer: Callable | None = None) -> StreamingQuery:
    """Process what has arrived, then stop. Restarting with the same checkpoint goes on from there."""
    out = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if writer:
        query = out.foreachBatch(writer).start()  # a batch that is run again has its old number
    else:
        query = out.format(sink).option("path", path).outputMode("append").start()
    query.awaitTermination()
    return query
