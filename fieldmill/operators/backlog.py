"""Which jobs of the job table are due again, and what requeueing them changes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from fieldmill import constants as K

MAX_ATTEMPTS, BATCH, STALE_MINUTES, GRACE_SECONDS = 3, 50, 10, 120


def _at(now: datetime) -> Column:
    return F.lit(now).cast("timestamp")


def _due(now: datetime) -> Column:
    return F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= _at(now))


def deferred(jobs: DataFrame, now: datetime, max_attempts: int = MAX_ATTEMPTS, batch: int = BATCH) -> DataFrame:
    """Queued jobs put off for quota whose time has come."""
    return (jobs.filter((F.col("status") == K.QUEUED) & F.col("deferred_reason").isNotNull()
                        & (F.col("attempts") < max_attempts) & _due(now))
            .orderBy(F.asc_nulls_first("next_retry_at"), "created_at", "job_id").limit(batch))


def stuck(jobs: DataFrame, now: datetime, max_attempts: int = MAX_ATTEMPTS, batch: int = BATCH,
          stale_minutes: int = STALE_MINUTES) -> DataFrame:
    """Running jobs that started too long ago."""
    cutoff = _at(now) - F.make_dt_interval(mins=F.lit(stale_minutes))
    return (jobs.filter((F.col("status") == K.RUNNING) & (F.col("attempts") < max_attempts)
                        & (F.col("started_at") < cutoff))
            .orderBy("started_at", "job_id").limit(batch))


def orphaned(jobs: DataFrame, now: datetime, max_attempts: int = MAX_ATTEMPTS, batch: int = BATCH,
             grace_seconds: int = GRACE_SECONDS) -> DataFrame:
    """Queued jobs, not put off, that nobody picked up in time."""
    cutoff = _at(now) - F.make_dt_interval(secs=F.lit(grace_seconds))
    return (jobs.filter((F.col("status") == K.QUEUED) & F.col("deferred_reason").isNull()
                        & (F.col("attempts") < max_attempts) & (F.col("created_at") < cutoff) & _due(now))
            .orderBy("created_at", "job_id").limit(batch))


def failed(jobs: DataFrame, now: datetime, max_attempts: int = MAX_ATTEMPTS, batch: int = BATCH) -> DataFrame:
    """Failed jobs with attempts left."""
    return (jobs.filter((F.col("status") == K.FAILED) & (F.col("attempts") < max_attempts) & _due(now))
            .orderBy(F.asc_nulls_first("finished_at"), "created_at", "job_id").limit(batch))


def due_jobs(jobs: DataFrame, now: datetime, max_attempts: int = MAX_ATTEMPTS, batch: int = BATCH,
             stale_minutes: int = STALE_MINUTES, grace_seconds: int = GRACE_SECONDS) -> DataFrame:
    """The four selections with their ``backlog`` class; status and deferral keep them disjoint."""
    parts = [("deferred", deferred(jobs, now, max_attempts, batch)),
             ("stuck", stuck(jobs, now, max_attempts, batch, stale_minutes)),
             ("pending", orphaned(jobs, now, max_attempts, batch, grace_seconds)),
             ("failed", failed(jobs, now, max_attempts, batch))]
    tagged = [df.withColumn("backlog", F.lit(name)) for name, df in parts]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def requeue(due: DataFrame, documents: DataFrame, stale_minutes: int = STALE_MINUTES,
            grace_seconds: int = GRACE_SECONDS) -> DataFrame:
    """Outcome per due job: new job and document status, message, audit action and details.

    ``due`` is at most four batches, so it is the side that is sent to the documents.
    """
    wanted = documents.select("doc_id", F.col("status").alias("doc_status")).join(
        F.broadcast(due.select("doc_id").distinct()), "doc_id", "left_semi")
    j = due.join(wanted, "doc_id", "left")
    gone, rejected = F.col("doc_status").isNull(), F.col("doc_status") == K.REJECTED
    base = F.try_element_at(F.create_map(*[F.lit(x) for kv in K.BACKLOG_ACTIONS.items() for x in kv]),
                            F.col("backlog"))
    n = F.col("job_id").cast("string")
    details = (F.when(F.col("backlog") == "deferred", F.concat(F.lit("Deferred job "), n, F.lit(
                    " is ready for retry and was requeued by Celery recovery.")))
               .when(F.col("backlog") == "stuck", F.concat(F.lit("Running job "), n, F.lit(
                   f" was stale for more than {stale_minutes} minutes and was reset to queued.")))
               .when(F.col("backlog") == "pending", F.concat(F.lit("Queued job "), n, F.lit(
                   f" was older than {grace_seconds} seconds and was requeued from PostgreSQL durable state.")))
               .otherwise(F.concat(F.lit("Failed job "), n, F.lit(
                   " still had attempts remaining and was requeued by Celery recovery."))))
    return j.select(
        "job_id", "doc_id", "backlog",
        F.when(gone | rejected, K.FAILED).otherwise(K.QUEUED).alias("job_status"),
        F.when(gone, F.lit(None)).when(rejected, K.REJECTED).otherwise(K.PENDING).alias("document_status"),
        F.when(gone, K.BACKLOG_MISSING).when(rejected, K.BACKLOG_REJECTED).alias("error_message"),
        F.when(gone, F.lit(None)).when(rejected, F.concat(base, F.lit("_skipped_rejected_document")))
        .otherwise(base).alias("action"),
        F.when(~gone, F.lit(K.BACKLOG_ACTOR)).alias("actor"),
        F.when(gone, F.lit(None)).when(rejected, F.concat(
            F.lit("Job "), n, F.lit(" was not requeued because the document is rejected.")))
        .otherwise(details).alias("details"))


def backlog_totals(requeued: DataFrame) -> DataFrame:
    """Requeued jobs per class (absent classes count 0) and in total."""
    ok = F.col("job_status") == K.QUEUED
    names = list(K.BACKLOG_ACTIONS)
    totals = requeued.agg(*[F.count_if(ok & (F.col("backlog") == c)).alias(c) for c in names],
                          F.count_if(ok).alias("total"))
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(f"{c}_requeued").alias("name"), F.col(c).alias("jobs"))
        for c in [*names, "total"]])))
