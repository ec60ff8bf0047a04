"""Tables that only grow: every write adds a version, reading resolves them, compaction is a job of its own.

A version is one folder `version=<n>` below the table. Writing it touches nothing else, as many tasks write as the rows have partitions,
and writing the same version again (a retried batch) replaces just that folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldmill.sources.files import _exists


def append(path: str, rows: DataFrame, version: int) -> None:
    """The rows as one version of the table."""
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")


def versions(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """All versions, with a column version. A table not written yet has none and the columns of `like`."""
    if not _exists(spark, path):
        if like is None:
            raise FileNotFoundError(path)
        return like.limit(0).withColumn("version", F.lit(0).cast("bigint"))
    return spark.read.option("basePath", path).parquet(f"{path}/version=*").withColumn("version", F.col("version").cast("bigint"))


def compact(spark: SparkSession, path: str, target: str, resolve: Callable[[DataFrame], DataFrame]) -> int:
    """Writes what `resolve` makes of all versions as one version of the table at `target`; returns its number.

    The old table stays as it is until readers and writers have moved on to the new one.
    """
    every = versions(spark, path)
    last = every.agg(F.max("version")).first()[0]
    append(target, resolve(every), last)
    return last


# --- rows of documents --------------------------------------------------------------------------

def append_documents(path: str, rows: DataFrame, documents: DataFrame, version: int) -> None:
    """The rows of re-processed documents (doc_id, ...). Each of `documents` leaves a marker, so that none of its older rows count."""
    marks = documents.select("doc_id").distinct().withColumn("is_marker", F.lit(True))
    append(path, rows.withColumn("is_marker", F.lit(False)).unionByName(marks, allowMissingColumns=True), version)


def newest_documents(every: DataFrame) -> DataFrame:
    """Rows and markers of each document's newest version. Only the markers are grouped."""
    newest = every.where("is_marker").groupBy("doc_id").agg(F.max("version").alias("version"))
    return every.join(newest, ["doc_id", "version"], "left_semi")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The rows of each document as it was written last."""
    return newest_documents(versions(spark, path)).where("not is_marker").drop("is_marker", "version")


def compact_documents(spark: SparkSession, path: str, target: str) -> int:
    """The newest rows and markers as one version of a new table."""
    return compact(spark, path, target, lambda every: newest_documents(every).drop("version"))


# --- values by key --------------------------------------------------------------------------------

def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row with the greatest order per key; reduced before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l")).select(key, "_l.*")
