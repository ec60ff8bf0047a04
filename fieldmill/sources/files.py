"""Readers and writers. Parquet and other splittable formats need none: use spark.read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldmill.operators.catalog import template_fields
from fieldmill.schemas import TEMPLATE_FILE

BUCKETS = 256


def read_uploads(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of any type as uploads: doc_id (hash of the path), filename, content_type, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option(
        "recursiveFileLookup", "true").load(path)
    return files.select(
        F.xxhash64("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.lit(None).cast("string").alias("content_type"), "content")


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """A folder of template files -> field rows; templates are ordered by file name."""
    files = spark.read.schema(TEMPLATE_FILE).json(path, multiLine=True)
    return template_fields(files.withColumn("file", F.col("_metadata.file_name")), "file")


def replace_by_document(old: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """Stored rows without those of the re-processed documents, plus the new rows."""
    return old.join(documents.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


def bucket_of(doc_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def write_replacing(path: str, new: DataFrame, documents: DataFrame, buckets: int = BUCKETS) -> None:
    """Replace the rows of ``documents`` in the table at ``path``; other buckets are not touched.

    A re-processed document leaves one marker row, so that a bucket is rewritten even when nothing
    of it remains. The commit swaps whole partitions: a lost task or a rerun changes nothing.
    """
    spark = new.sparkSession
    done = documents.select("doc_id").distinct()
    marks = done.select("doc_id", F.lit(True).alias("is_marker"))
    rows = new.withColumn("is_marker", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    rows = rows.withColumn("bucket", bucket_of(F.col("doc_id"), buckets))
    if _exists(spark, path):
        touched = done.select(bucket_of(F.col("doc_id"), buckets).alias("bucket")).distinct()
        kept = (spark.read.parquet(path).join(F.broadcast(touched), "bucket", "left_semi")
                .join(done, "doc_id", "left_anti"))
        rows = kept.unionByName(rows, allowMissingColumns=True)
    (rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def read_fields(path: str, spark: SparkSession) -> DataFrame:
    """The table written by ``write_replacing`` without its marker rows."""
    return spark.read.parquet(path).filter("not is_marker").drop("is_marker", "bucket")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)
