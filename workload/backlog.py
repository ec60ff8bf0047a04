"""Due jobs of the job table."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from fieldmill import constants as K
from fieldmill.operators import backlog as B
from workload.registry import Tables, q, query

NOW = datetime(1998, 6, 1, tzinfo=timezone.utc)
_NOW = "TIMESTAMP '1998-06-01 00:00:00'"
_DUE = f"(next_retry_at IS NULL OR next_retry_at <= {_NOW})"
_SELECT = {
    "deferred": f"status = 'queued' AND deferred_reason IS NOT NULL AND attempts < 3 AND {_DUE} ORDER BY next_retry_at NULLS FIRST, created_at, job_id",
    "stuck": f"status = 'running' AND attempts < 3 AND started_at < {_NOW} - INTERVAL 10 MINUTE ORDER BY started_at, job_id",
    "pending": f"status = 'queued' AND deferred_reason IS NULL AND attempts < 3 AND created_at < {_NOW} - INTERVAL 120 SECOND AND {_DUE} ORDER BY created_at, job_id",
    "failed": f"status = 'failed' AND attempts < 3 AND {_DUE} ORDER BY finished_at NULLS FIRST, created_at, job_id",
}


def _selection(kind: str) -> str:
    return f"(SELECT *, '{kind}' AS backlog FROM @jobs j WHERE {_SELECT[kind]} LIMIT 50)"


def _one(name: str, kind: str, pick):
    @query(name, f"SELECT job_id, doc_id, attempts FROM {_selection(kind)} s")
    def run(t: Tables):
        return pick(t.jobs, NOW).select("job_id", "doc_id", "attempts")


_one("backlog_deferred", "deferred", B.deferred)
_one("backlog_stuck", "stuck", B.stuck)
_one("backlog_orphaned", "pending", B.orphaned)
_one("backlog_failed", "failed", B.failed)

_BASE = "CASE backlog " + " ".join(f"WHEN {q(c)} THEN {q(a)}" for c, a in K.BACKLOG_ACTIONS.items()) + " END"
_REQUEUED = f"""(SELECT b.job_id, b.doc_id, backlog, CASE WHEN d.status IS NULL OR d.status = 'rejected' THEN 'failed' ELSE 'queued' END AS job_status,
  CASE WHEN d.status = 'rejected' THEN 'rejected' WHEN d.status IS NOT NULL THEN 'pending' END AS document_status,
  CASE WHEN d.status IS NULL THEN {q(K.BACKLOG_MISSING)} WHEN d.status = 'rejected' THEN {q(K.BACKLOG_REJECTED)} END AS error_message,
  CASE WHEN d.status = 'rejected' THEN {_BASE} || '_skipped_rejected_document' WHEN d.status IS NOT NULL THEN {_BASE} END AS action,
  CASE WHEN d.status = 'rejected' THEN 'Job ' || b.job_id || ' was not requeued because the document is rejected.' WHEN d.status IS NOT NULL THEN
    CASE backlog WHEN 'deferred' THEN 'Deferred job ' || b.job_id || ' is ready for retry and was requeued by Celery recovery.'
      WHEN 'stuck' THEN 'Running job ' || b.job_id || ' was stale for more than 10 minutes and was reset to queued.'
      WHEN 'pending' THEN 'Queued job ' || b.job_id || ' was older than 120 seconds and was requeued from PostgreSQL durable state.'
      ELSE 'Failed job ' || b.job_id || ' still had attempts remaining and was requeued by Celery recovery.' END END AS details
  FROM ({' UNION ALL '.join('SELECT * FROM ' + _selection(k) + ' s' for k in _SELECT)}) b LEFT JOIN @app_documents d ON d.doc_id = b.doc_id)"""


def requeued(t: Tables):
    return B.requeue(B.due_jobs(t.jobs, NOW), t.app_documents)


@query("backlog_requeue", f"SELECT * FROM {_REQUEUED} r")
def backlog_requeue(t: Tables):
    return requeued(t).drop("actor")


@query("backlog_totals", f"""
WITH r AS (SELECT * FROM {_REQUEUED} x WHERE job_status = 'queued')
SELECT k || '_requeued' AS name, (SELECT count(*) FROM r WHERE k = 'total' OR backlog = k) AS jobs
FROM (VALUES ('deferred'), ('stuck'), ('pending'), ('failed'), ('total')) v(k)""")
def backlog_totals(t: Tables):
    return B.backlog_totals(requeued(t))
