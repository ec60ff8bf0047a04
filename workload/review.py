"""Decisions, corrections, reviewer actions, audit rows and briefings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fieldmill import constants as K
from fieldmill.functions import review as C
from fieldmill.operators import review as R
from fieldmill.operators.skew import asked_for
from workload import duck as D
from workload.registry import INPUTS, Tables, q, query
from workload.templates import BUNDLED
from workload.validation import _check

_NEEDS = "(requires_review OR coalesce(confidence, 0) < 0.8 OR NOT auto_accept)"


def _validated(t: Tables):
    s = t.stored_fields.drop("accepted", "needs_review", "accepted_by")
    return s.withColumn("auto_accept", (F.floor(F.col("field_id") / 6) + F.col("field_id") % 6) % 3 != 0).withColumn(
        "requires_review", F.col("validation_status").isin("invalid", "missing_required"))


_VALIDATED = """(SELECT s.* EXCLUDE (accepted, needs_review, accepted_by), (field_id // 6 + field_id % 6) % 3 <> 0 AS auto_accept,
  validation_status IN ('invalid', 'missing_required') AS requires_review FROM @stored_fields s)"""


@query("confidence_threshold", """
SELECT event_id, greatest(0, least(1, CASE WHEN v > 1 THEN v / 100 ELSE v END)) AS threshold FROM (
  SELECT event_id, coalesce(try_cast(CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN CAST(-event_id AS VARCHAR)
    WHEN 2 THEN CAST(event_id AS VARCHAR) ELSE '0.' || event_id END AS DOUBLE), 0.8) AS v FROM events) e""")
def confidence_threshold(t: Tables):
    n = F.col("event_id").cast("string")
    raw = F.when(F.col("event_id") % 4 == 0, "high").when(F.col("event_id") % 4 == 1, (-F.col("event_id")).cast("string")).when(
        F.col("event_id") % 4 == 2, n).otherwise(F.concat(F.lit("0."), n))
    return t.events.select("event_id", C.threshold_column(raw).alias("threshold"))


@query("low_confidence", "SELECT field_id, coalesce(confidence, 0) < 0.8 AS low FROM @raw_fields f")
def low_confidence(t: Tables):
    return t.raw_fields.select("field_id", C.low_confidence(F.col("confidence")).alias("low"))


@query("field_decision", f"""
SELECT field_id, {_NEEDS} AS needs_review, auto_accept AND NOT {_NEEDS} AS accepted,
  CASE WHEN auto_accept AND NOT {_NEEDS} THEN 'system' END AS accepted_by FROM {_VALIDATED} v""")
def field_decision(t: Tables):
    return R.decide(_validated(t)).select("field_id", "needs_review", "accepted", "accepted_by")


@query("document_status", f"""
SELECT doc_id, CASE WHEN bool_or({_NEEDS}) THEN 'needs_review' ELSE 'approved' END AS status,
  count(*) FILTER (WHERE auto_accept AND NOT {_NEEDS}) AS accepted_fields,
  count(*) FILTER (WHERE NOT (auto_accept AND NOT {_NEEDS})) AS review_fields FROM {_VALIDATED} v GROUP BY doc_id""")
def document_status(t: Tables):
    return R.document_status(R.decide(_validated(t)))


_LATEST = """(SELECT field_id, arg_max(corrected_value, (corrected_at, correction_id)) AS lastv FROM @correction_log c GROUP BY field_id)"""
DISPLAYED = f"""(SELECT s.*, l.field_id IS NOT NULL AS corrected, CASE WHEN l.field_id IS NOT NULL THEN lastv ELSE extracted_value END
  AS display_value FROM @stored_fields s LEFT JOIN {_LATEST} l ON l.field_id = s.field_id)"""


def displayed(t: Tables):
    return R.display_values(t.stored_fields, t.correction_log)


@query("display_value", f"SELECT field_id, corrected, display_value FROM {DISPLAYED} d")
def display_value(t: Tables):
    return displayed(t).select("field_id", "corrected", "display_value")


_FOLD = lambda x: f"regexp_replace({D.strip(f'lower({x})')}, '[[:space:]]+', ' ', 'g')"
SCORED = f"""(SELECT *, CASE WHEN NOT corrected THEN round(confidence, 4) WHEN extracted_value = display_value THEN 1.0
    WHEN a <> '' AND a = b THEN 0.98 WHEN a = '' AND b = '' THEN 1.0 WHEN a = '' OR b = '' THEN 0.0
    ELSE round(1 - CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b), 1), 4) END AS review_confidence
  FROM (SELECT *, {_FOLD('extracted_value')} AS a, {_FOLD('display_value')} AS b FROM {DISPLAYED} d) e)"""


def scored(t: Tables, method: str = "sequence"):
    return R.review_confidence(displayed(t), method)


# The sequence ratio has no SQL form; tests check it against the standard library pair by pair.
@query("review_confidence")
def review_confidence(t: Tables):
    return scored(t).select("field_id", "review_confidence")


@query("review_confidence_edit", f"SELECT field_id, review_confidence FROM {SCORED} s")
def review_confidence_edit(t: Tables):
    return scored(t, "levenshtein").select("field_id", "review_confidence")


@query("review_status")
def review_status(t: Tables):
    return R.review_statuses(scored(t)).select("field_id", "review_status")


@query("review_status_edit", f"""
SELECT field_id, CASE WHEN NOT accepted AND needs_review THEN 'needs_review' WHEN NOT accepted THEN 'awaiting_acceptance'
  WHEN NOT corrected THEN 'accepted_original' WHEN review_confidence >= 0.98 THEN 'accepted_same'
  WHEN review_confidence >= 0.75 THEN 'accepted_minor_change' ELSE 'accepted_modified' END AS review_status FROM {SCORED} s""")
def review_status_edit(t: Tables):
    return R.review_statuses(scored(t, "levenshtein")).select("field_id", "review_status")


_DOUBT = "(coalesce(confidence, 0) < 0.8 OR validation_status IN ('invalid', 'missing_required'))"
_TAKE = f"(NOT accepted AND NOT {_DOUBT} AND extracted_value = display_value)"
AUTO = f"""(SELECT * EXCLUDE (accepted, needs_review, accepted_by), {_TAKE} AS auto_accepted,
  CASE WHEN NOT accepted AND {_DOUBT} THEN true WHEN {_TAKE} THEN false ELSE needs_review END AS needs_review,
  accepted OR {_TAKE} AS accepted, CASE WHEN {_TAKE} THEN 'system' ELSE accepted_by END AS accepted_by FROM {DISPLAYED} d)"""


def auto_accepted(t: Tables):
    return R.auto_accept_exact(displayed(t))


@query("auto_accept_exact", f"""
SELECT 'field' AS kind, field_id AS id, auto_accepted, needs_review, accepted, accepted_by, NULL AS details FROM {AUTO} a
UNION ALL SELECT 'audit', doc_id, NULL, NULL, NULL, 'system', 'Auto-accepted ' || n || ' field(s) because the original extracted value '
  || 'exactly matched the current review/display value and met the 80% confidence threshold: ' || array_to_string(names[1:8], ', ')
  || CASE WHEN n > 8 THEN ', and ' || (n - 8) || ' more' ELSE '' END || '.'
FROM (SELECT doc_id, count(*) AS n, list(field_name ORDER BY field_id) AS names FROM {AUTO} a WHERE auto_accepted GROUP BY doc_id) n""")
def auto_accept_exact(t: Tables):
    fields = auto_accepted(t)
    audit = R.auto_accept_audit(fields).select(
        F.lit("audit").alias("kind"), F.col("doc_id").alias("id"), F.col("actor").alias("accepted_by"), "details")
    rows = fields.select(F.lit("field").alias("kind"), F.col("field_id").alias("id"), "auto_accepted", "needs_review",
                         "accepted", "accepted_by")
    return rows.unionByName(audit, allowMissingColumns=True)


_REFRESHED = f"""(SELECT d.doc_id, d.status, coalesce(total_fields, 0) AS total_fields, coalesce(blocking_fields, 0) AS blocking_fields,
  CASE WHEN d.status IN ('error', 'pending', 'rejected') THEN d.status WHEN coalesce(total_fields, 0) > 0 AND blocking_fields = 0
    THEN 'approved' ELSE 'needs_review' END AS new_status FROM @app_documents d LEFT JOIN (
  SELECT doc_id, count(*) AS total_fields, count(*) FILTER (WHERE needs_review OR NOT accepted) AS blocking_fields FROM {AUTO} a
  GROUP BY doc_id) c ON c.doc_id = d.doc_id)"""


def refreshed(t: Tables):
    return R.refresh_status(t.app_documents.select("doc_id", "status"), auto_accepted(t))


@query("refresh_status", f"""
SELECT doc_id, status, new_status, total_fields, blocking_fields, NULL AS action, NULL AS details FROM {_REFRESHED} r
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, 'document_state_changed', 'Document status changed from ' || status || ' to ' || new_status
  || '. Approval requires all ' || total_fields || ' fields accepted and zero fields needing review; ' || blocking_fields
  || ' blocking field(s) remain.' FROM {_REFRESHED} r WHERE status <> new_status
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, 'document_approved', 'Document approved by system. All ' || total_fields
  || ' extracted field(s) are accepted and zero fields require review.' FROM {_REFRESHED} r
  WHERE status <> new_status AND new_status = 'approved'""")
def refresh_status(t: Tables):
    docs = refreshed(t)
    return docs.select("doc_id", "status", "new_status", "total_fields", "blocking_fields").unionByName(
        R.status_audit(docs).select("doc_id", "action", "details"), allowMissingColumns=True)


# --- reviewer actions -------------------------------------------------------------------------

_FOLD_FIELDS = """(SELECT field_id, doc_id, field_name, extracted_value, standard_field_key, data_type, required,
  accepted AND NOT needs_review AS settled FROM @stored_fields s)"""


def _validity(value: str, name: str, part: str) -> str:
    """Validation without template rules of other columns than `value` and `field_name`."""
    text = _check(part).replace("no value was", "no @ was")
    for col, put in (("lo", "CAST(NULL AS DOUBLE)"), ("minlen", "CAST(NULL AS INT)"), ("pat", "CAST(NULL AS VARCHAR)"),
                     ("cur", "false"), ("allowed", "false"), ("must", "false"), ("value", value), ("field_name", name)):
        text = re.sub(rf"(?<![\w'.]){col}(?![\w'])(?=[ ,);]|$|\s)", put, text)
    return text.replace("no @ was", "no value was")


FOLDED = f"""(
WITH RECURSIVE base AS (
  SELECT a.action_id, a.ts, a.kind, a.field_id, a.actor, s.doc_id, s.field_name AS first_name, s.extracted_value, s.standard_field_key, s.data_type,
    s.required, s.settled, s.field_id IS NOT NULL AS known, CASE WHEN kind = 'correct' THEN {D.strip("nullif(a.field_name, '')")} END AS name,
    CASE WHEN kind = 'correct' THEN a.value END AS given
  FROM @actions a LEFT JOIN {_FOLD_FIELDS} s ON s.field_id = a.field_id WHERE kind IN ('correct', 'accept')),
ruled AS (SELECT *, CASE WHEN NOT known THEN {q(K.REFUSED_NO_FIELD)}
    WHEN standard_field_key IS NOT NULL AND name <> first_name THEN {q(K.REFUSED_LOCKED)} WHEN name = '' THEN {q(K.REFUSED_NAME)}
    WHEN given IS NOT NULL AND {D.strip('given')} = '' THEN {q(K.REFUSED_VALUE)} END AS r0 FROM base),
chained AS (SELECT *, coalesce(last_value(CASE WHEN r0 IS NULL THEN given END IGNORE NULLS) OVER w, extracted_value) AS old_value,
    coalesce(last_value(CASE WHEN r0 IS NULL THEN name END IGNORE NULLS) OVER w, first_name) AS old_name,
    coalesce(bool_or(r0 IS NULL) OVER w, false) AS touched
  FROM ruled WINDOW w AS (PARTITION BY field_id ORDER BY ts, action_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
moved AS (SELECT *, coalesce(CASE WHEN r0 IS NULL THEN given END, old_value) AS new_value,
    CASE WHEN standard_field_key IS NOT NULL THEN old_name ELSE coalesce(CASE WHEN r0 IS NULL THEN name END, old_name) END AS new_name FROM chained),
ready AS (SELECT *, coalesce(r0, CASE WHEN kind = 'correct' AND {D.blank('new_value')} THEN {q(K.REFUSED_VALUE)} END) AS refusal,
    coalesce(standard_field_key, new_name) AS ident FROM moved),
checked AS (SELECT *, {_validity('new_value', 'ident', 'status')} AS vs, {_validity('new_value', 'ident', 'message')} AS vm,
    {_validity('old_value', 'ident', 'status')} AS os FROM ready)
SELECT action_id, kind, doc_id, field_id, actor, ts, refusal, old_name, new_name, old_value, new_value, vs AS validation_status, vm AS validation_message,
  vs NOT IN ('invalid', 'missing_required') AS new_accepted,
  CASE WHEN refusal IS NOT NULL THEN 'refused' WHEN kind = 'correct' AND new_value = old_value AND new_name = old_name AND
      CASE WHEN touched AND NOT {D.blank('old_value')} THEN os NOT IN ('invalid', 'missing_required') ELSE settled END THEN 'unchanged'
    WHEN kind = 'accept' AND vs IN ('invalid', 'missing_required') THEN 'blocked' ELSE 'applied' END AS outcome FROM checked)"""


def folded(t: Tables):
    return R.fold_actions(t.stored_fields, t.actions.filter("kind in ('correct', 'accept')"))


_SHOWN = ["action_id", "field_id", "outcome", "refusal", "old_name", "new_name", "old_value", "new_value", "validation_status"]


@query("apply_corrections", f"SELECT {', '.join(_SHOWN)} FROM {FOLDED} f WHERE kind = 'correct'")
def apply_corrections(t: Tables):
    return folded(t).filter("kind = 'correct'").select(*_SHOWN)


@query("apply_accepts", f"SELECT {', '.join(_SHOWN)}, new_accepted FROM {FOLDED} f WHERE kind = 'accept'")
def apply_accepts(t: Tables):
    return folded(t).filter("kind = 'accept'").select(*_SHOWN, "new_accepted")


@query("reviewed_states", f"""
SELECT field_id, arg_max(new_name, (ts, action_id)) AS field_name, arg_max(new_value, (ts, action_id)) AS display_value,
  arg_max(new_accepted, (ts, action_id)) AS accepted, NOT arg_max(new_accepted, (ts, action_id)) AS needs_review,
  arg_max(validation_status, (ts, action_id)) AS validation_status,
  CASE WHEN arg_max(new_accepted, (ts, action_id)) THEN arg_max(actor, (ts, action_id)) END AS accepted_by
FROM {FOLDED} f WHERE outcome IN ('applied', 'blocked') GROUP BY field_id""")
def reviewed_states(t: Tables):
    return R.field_states(folded(t))


@query("new_corrections", f"""
SELECT action_id AS correction_id, field_id, old_value, new_value AS corrected_value, actor AS corrected_by FROM {FOLDED} f
WHERE outcome = 'applied' AND kind = 'correct' AND new_value <> old_value""")
def new_corrections(t: Tables):
    return R.new_corrections(folded(t)).drop("corrected_at")


_ADD = f"""(SELECT a.action_id, a.doc_id, a.actor, d.status, d.document_type_key AS tk, {D.strip("coalesce(a.field_name, 'Total ' || (a.action_id % 3))")} AS given,
  {D.strip("coalesce(a.value, '')")} AS value, a.source_snippet FROM @actions a LEFT JOIN @app_documents d ON d.doc_id = a.doc_id WHERE kind = 'add')"""


def additions(t: Tables):
    return t.actions.filter("kind = 'add'").withColumn("field_name", F.coalesce(
        "field_name", F.concat(F.lit("Total "), (F.col("action_id") % 3).cast("string"))))


ORACLE_ADD = f"""
WITH a AS (SELECT * FROM {_ADD} x), m AS (SELECT action_id, arg_min(fkey, forder) AS fkey, arg_min(dtype, forder) AS dtype, arg_min(req, forder) AS req
  FROM (SELECT action_id, tk, unnest({D.candidates('given')}) AS c FROM a) c JOIN (SELECT *, unnest(synonyms) AS syn FROM {D.template_fields()} f) s
  ON s.template = c.tk AND s.syn = c.c GROUP BY action_id),
n AS (SELECT a.*, fkey, CASE WHEN fkey IS NOT NULL THEN fkey WHEN tk IS NOT NULL THEN '{K.SUGGESTED}' || replace(lower(given), ' ', '_')
    ELSE given END AS field_name, CASE WHEN fkey IS NOT NULL THEN dtype WHEN tk IS NOT NULL THEN 'suggestion' END AS data_type,
    coalesce(req, false) AS required, CASE WHEN dtype = 'currency' THEN CAST(0 AS DOUBLE) END AS lo, CASE WHEN dtype = 'string' THEN 1 END AS minlen,
    CAST(NULL AS VARCHAR) AS pat, false AS cur, false AS allowed, false AS must FROM a LEFT JOIN m ON m.action_id = a.action_id)
SELECT action_id, doc_id, field_name, fkey AS standard_field_key, CASE WHEN fkey IS NOT NULL THEN tk END AS template_key, data_type, required,
  value AS extracted_value, coalesce(source_snippet, {q(K.MANUAL_SNIPPET)}) AS snippet, {_check('status')} AS validation_status,
  CASE WHEN status IS NULL THEN {q(K.REFUSED_NO_DOCUMENT)} WHEN status = 'rejected' THEN {q(K.REFUSED_READONLY)}
    WHEN given = '' THEN {q(K.REFUSED_ADD_NAME)} WHEN value = '' THEN {q(K.REFUSED_ADD_VALUE)} END AS refusal FROM n"""


@query("apply_additions", ORACLE_ADD)
def apply_additions(t: Tables):
    return R.apply_additions(additions(t), t.app_documents, BUNDLED).select(
        "action_id", "doc_id", "field_name", "standard_field_key", "template_key", "data_type", "required",
        "extracted_value", "snippet", "validation_status", "refusal")


_REMOVABLE = """(field_name LIKE 'suggested!_extra!_fields.%' ESCAPE '!' OR contains(reasoning, 'Manually added by reviewer') OR data_type = 'suggestion')"""


@query("apply_removals", f"""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY ts, action_id) AS n FROM @actions x WHERE kind = 'remove'),
s AS (SELECT *, {_REMOVABLE} AS can FROM @stored_fields f),
r AS (SELECT a.action_id, a.field_id, s.field_name, CASE WHEN s.can IS NULL OR (s.can AND n > 1) THEN {q(K.REFUSED_NO_FIELD)}
    WHEN NOT s.can THEN {q(K.REFUSED_REMOVE)} END AS refusal FROM a LEFT JOIN s ON s.field_id = a.field_id)
SELECT 'action' AS kind, action_id AS id, field_name, refusal FROM r
UNION ALL SELECT 'field', field_id, field_name, NULL FROM s WHERE NOT (can AND field_id IN (SELECT field_id FROM a))""")
def apply_removals(t: Tables):
    left, report = R.apply_removals(t.stored_fields, t.actions.filter("kind = 'remove'"))
    return report.select(F.lit("action").alias("kind"), F.col("action_id").alias("id"), "field_name", "refusal").unionByName(
        left.select(F.lit("field").alias("kind"), F.col("field_id").alias("id"), "field_name"), allowMissingColumns=True)


_LABELS = "CASE code " + " ".join(f"WHEN {q(c)} THEN {q(x)}" for c, x in K.REJECTION_REASONS) + " ELSE 'Other' END"
REJECTED = f"""(SELECT *, CASE WHEN note = '' THEN {_LABELS} ELSE {_LABELS} || ': ' || note END AS stored,
  CASE WHEN status IS NULL THEN {q(K.REFUSED_NO_DOCUMENT)} WHEN n > 1 OR NOT (status IN ('pending', 'needs_review')
    OR (status = 'approved' AND extraction_mode = 'auto_detect')) THEN {q(K.REFUSED_STATE)} END AS refusal
  FROM (SELECT a.*, d.status, d.extraction_mode, coalesce(nullif(reason_code, ''), 'other') AS code, {D.strip("coalesce(reason, '')")} AS note,
    row_number() OVER (PARTITION BY a.doc_id ORDER BY ts, action_id) AS n FROM @actions a LEFT JOIN @app_documents d ON d.doc_id = a.doc_id
    WHERE kind = 'reject') x)"""


def rejections(t: Tables):
    return R.apply_rejections(t.app_documents, t.actions.filter("kind = 'reject'"))


@query("apply_rejections", f"""
SELECT action_id, doc_id, refusal, CASE WHEN refusal IS NULL THEN stored END AS stored_reason, CASE WHEN refusal IS NULL THEN
  'Document status changed from ' || status || ' to rejected by ' || actor || '. Reason: ' || stored || ' (code: ' || code || ').' END AS details
FROM {REJECTED} r""")
def apply_rejections(t: Tables):
    return rejections(t).select("action_id", "doc_id", "refusal", "stored_reason", "details")


@query("rejected_are_readonly", f"""
SELECT action_id, doc_id, CASE WHEN a.ts >= r.at_ts THEN {q(K.REFUSED_READONLY)} END AS refusal
FROM (SELECT action_id, doc_id, ts FROM @actions x WHERE kind <> 'reject') a LEFT JOIN
  (SELECT doc_id, min(ts) AS at_ts FROM {REJECTED} j WHERE refusal IS NULL GROUP BY doc_id) r USING (doc_id)""")
def rejected_are_readonly(t: Tables):
    closed = rejections(t).filter("outcome = 'rejected'").select("doc_id", F.col("ts").alias("rejected_at"))
    allowed, refused = R.split_readonly(t.actions.filter("kind <> 'reject'"), closed)
    return allowed.unionByName(refused, allowMissingColumns=True).select("action_id", "doc_id", "refusal")


_Q = lambda c: f"'\"' || {c} || '\"'"


# How jobs end, and who briefs the reviewers.
_ENDED = """SELECT doc_id, job_id, 'p1' AS provider, 'm1' AS model, 'minute' AS window_type, 30 AS quota, 'day ' || job_id AS retry_at, 'broken ' || job_id AS error,
  CASE job_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'deferred' WHEN 2 THEN 'rejected_before' WHEN 3 THEN 'rejected_while' ELSE 'done' END AS ending FROM """
_BRIEFED = """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'p1' ELSE 'system' END AS provider, 'm1' AS model,
  CASE WHEN doc_id % 4 = 1 THEN 'quota ' || doc_id END AS limited, CASE WHEN doc_id % 4 < 3 THEN 'down ' || doc_id END AS error FROM """


@query("audit_events", f"""
WITH f AS (SELECT * FROM {FOLDED} x WHERE outcome IN ('applied', 'blocked')),
r AS (SELECT * FROM {REJECTED} x WHERE refusal IS NULL),
s AS (SELECT doc_id, CASE WHEN bool_or({_NEEDS}) THEN 'needs_review' ELSE 'approved' END AS status,
  count(*) FILTER (WHERE auto_accept AND NOT {_NEEDS}) AS a, count(*) FILTER (WHERE NOT (auto_accept AND NOT {_NEEDS})) AS b FROM {_VALIDATED} v GROUP BY doc_id)
SELECT doc_id, 'field_name_changed' AS action, actor, 'Extraction field name changed from ' || {_Q('old_name')} || ' to ' || {_Q('new_name')} || '.' AS details
FROM f WHERE kind = 'correct' AND new_name <> old_name
UNION ALL SELECT doc_id, 'field_reviewed', actor, new_name || ': ' || CASE WHEN new_name <> old_name AND new_value <> old_value THEN
    'field name changed from ' || {_Q('old_name')} || ' to ' || {_Q('new_name')} || '; display value changed from ' || {_Q('old_value')} || ' to ' || {_Q('new_value')}
  WHEN new_name <> old_name THEN 'field name changed from ' || {_Q('old_name')} || ' to ' || {_Q('new_name')}
  WHEN new_value <> old_value THEN 'display value changed from ' || {_Q('old_value')} || ' to ' || {_Q('new_value')}
  ELSE 'field ' || {_Q('new_name')} || ' accepted without changes' END || '.' FROM f WHERE kind = 'correct'
UNION ALL SELECT doc_id, 'field_acceptance_blocked_by_validation', actor, new_name || ': cannot be accepted because validation failed: ' || validation_message
FROM f WHERE outcome = 'blocked'
UNION ALL SELECT doc_id, 'field_accepted', actor, new_name || ': accepted display value ' || {_Q('new_value')} || '.' FROM f WHERE kind = 'accept'
UNION ALL SELECT doc_id, unnest(['document_rejected', 'document_state_changed']), actor, 'Document status changed from ' || status || ' to rejected by '
  || actor || '. Reason: ' || stored || ' (code: ' || code || ').' FROM r
UNION ALL SELECT doc_id, 'processing_started', 'worker', 'Job ' || doc_id || ' started from PostgreSQL state.' FROM s
UNION ALL SELECT doc_id, 'extraction_strategy_selected', 'worker', 'Extraction strategy: deterministic.' FROM s
UNION ALL SELECT doc_id, 'structured_fields_auto_accepted', 'worker', 'Auto-accepted ' || a || ' field(s); ' || b || ' field(s) still require review. '
  || 'Confidence threshold: 80%. Validation rules were applied to extracted/template fields. AI Review Assistant: created.' FROM s
UNION ALL SELECT doc_id, 'processing_finished', 'worker', 'Job ' || doc_id || ' completed and extraction rows committed. Document status is ' || status || '.' FROM s
UNION ALL SELECT doc_id, 'document_approved', 'system', 'Document approved automatically by the system because all extracted fields were accepted during '
  || 'deterministic structured-data processing and no fields require review.' FROM s WHERE status = 'approved'
UNION ALL SELECT doc_id, 'document_created', 'api', 'Raw input parsed via ' || parser_type || '; document and durable processing job stored in PostgreSQL. Mode: '
  || extraction_mode || CASE WHEN document_type_label IS NOT NULL THEN '. Template selected: ' || document_type_label || '.' ELSE '. No template selected; free discovery extraction will be used.' END
  FROM @app_documents d
UNION ALL SELECT doc_id, 'job_queued', 'api', 'Celery received only the PostgreSQL processing_jobs.id.' FROM @app_documents d
UNION ALL SELECT doc_id, 'field_manually_added', actor, field_name || ': manually added with value "' || extracted_value || '". Validation status: ' || validation_status || '.'
  FROM ({ORACLE_ADD}) a JOIN (SELECT action_id, actor FROM @actions x) b USING (action_id) WHERE refusal IS NULL
UNION ALL SELECT doc_id, 'field_removed', actor, field_name || ': removed from extracted fields. Previous display value was "' || extracted_value || '".'
  FROM (SELECT a.actor, s.*, row_number() OVER (PARTITION BY a.field_id ORDER BY ts, action_id) AS n FROM @actions a JOIN @stored_fields s ON s.field_id = a.field_id
    WHERE kind = 'remove') r WHERE n = 1 AND {_REMOVABLE}
UNION ALL SELECT doc_id, CASE ending WHEN 'failed' THEN 'processing_failed' WHEN 'deferred' THEN 'ai_rate_limited_job_deferred'
    WHEN 'rejected_before' THEN 'processing_skipped_rejected_document' ELSE 'processing_write_skipped_rejected_document' END, 'worker',
  CASE ending WHEN 'failed' THEN error WHEN 'deferred' THEN 'Job ' || job_id || ' kept pending because p1/m1 reached its minute quota of 30. Next retry after ' || retry_at || '.'
    WHEN 'rejected_before' THEN 'Job ' || job_id || ' skipped because document #' || doc_id || ' is rejected.'
    ELSE 'Job ' || job_id || ' completed extraction work but skipped database writes because document #' || doc_id || ' was rejected.' END
  FROM ({_ENDED} @jobs j) e WHERE ending <> 'done'
UNION ALL SELECT doc_id, unnest(CASE WHEN provider <> 'system' THEN ['ai_review_assistant_completed'] WHEN limited IS NOT NULL THEN ['ai_review_assistant_deferred_or_skipped', 'ai_review_assistant_fallback_created']
    WHEN error IS NOT NULL THEN ['ai_review_assistant_skipped', 'ai_review_assistant_fallback_created'] ELSE ['ai_review_assistant_fallback_created'] END), 'worker',
  unnest(CASE WHEN provider <> 'system' THEN ['AI Review Assistant generated reviewer briefing using ' || provider || '/m1.']
    WHEN limited IS NOT NULL THEN ['AI Review Assistant provider skipped because quota was reached: ' || limited, 'Deterministic AI Review Assistant fallback created. Reason: provider quota was reached: ' || limited]
    WHEN error IS NOT NULL THEN ['AI Review Assistant provider failed non-fatally: ' || error, 'Deterministic AI Review Assistant fallback created. Reason: provider failed non-fatally: ' || error]
    ELSE ['Deterministic AI Review Assistant fallback created. Reason: ' || {q(K.BRIEFING['default_reason'])}] END) FROM ({_BRIEFED} @app_documents d) b""")
def audit_events(t: Tables):
    adds = R.apply_additions(additions(t), t.app_documents, BUNDLED)
    removes = t.actions.filter("kind = 'remove'")
    _, report = R.apply_removals(t.stored_fields, removes)
    removed = report.join(removes.select("action_id", "actor"), "action_id").join(
        asked_for(t.stored_fields, removes, ["field_id"]).select("field_id", "doc_id", F.col("extracted_value").alias("display_value")).hint("merge"),
        "field_id")
    more = (R.creation_audit(t.app_documents), R.addition_audit(adds), R.removal_audit(removed),
            R.job_audit(t.sql(_ENDED + "(" + INPUTS["jobs"] + ") j")), R.briefing_audit(t.sql(_BRIEFED + "(" + INPUTS["app_documents"] + ") d")))
    return reduce(DataFrame.unionByName, more, _finished_audit(t))


def _finished_audit(t: Tables):
    runs = R.document_status(R.decide(_validated(t))).withColumn("job_id", F.col("doc_id")).withColumn(
        "strategy", F.lit("deterministic"))
    return (R.fold_audit(folded(t)).unionByName(R.rejection_audit(rejections(t)))
            .unionByName(R.processing_audit(runs)))


# --- briefings --------------------------------------------------------------------------------

_B = K.BRIEFING
_TOP = lambda cond, said: f"(list({said} ORDER BY pos, {said}) FILTER (WHERE {cond}))[1:12]"
_MISS, _INV, _LOWC = f"(required AND {D.blank('value')})", "(validation_status = 'invalid')", "(coalesce(confidence, 0) < 0.8)"


@query("reviewer_briefing", f"""
WITH f AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE {_MISS}) AS n_m, count(*) FILTER (WHERE {_INV}) AS n_v, count(*) FILTER (WHERE {_LOWC}) AS n_l,
  {D.mean_units('confidence', 3)} / 1000 AS c, {_TOP(_MISS, 'field_name')} AS m,
  {_TOP(_INV, "(field_name || ': ' || validation_message)")} AS v, {_TOP(_LOWC, 'field_name')} AS l FROM @stored_fields s GROUP BY doc_id),
d AS (SELECT a.doc_id, a.filename, CASE WHEN a.doc_id % 10 = 0 THEN a.document_type_key ELSE a.document_type_label END AS document_type_label, coalesce(n, 0) AS n, coalesce(n_m, 0) AS n_m, coalesce(n_v, 0) AS n_v, coalesce(n_l, 0) AS n_l,
  coalesce(c, 0) AS c, m, v, l FROM @app_documents a LEFT JOIN f ON f.doc_id = a.doc_id)
SELECT doc_id, c AS overall_confidence, CASE WHEN n_v > 0 OR n_m >= 3 THEN 'poor' WHEN n_m + n_l > 0 OR n = 0 THEN 'needs_review' ELSE 'good' END AS document_quality,
  'Deterministic reviewer briefing generated for ' || coalesce(filename, 'this document') || '. Extraction strategy: deterministic. {_B['default_reason']}.' AS summary,
  CASE WHEN n_m + n_v + n_l > 0 OR n = 0 THEN {q(_B['issues'])} ELSE {q(_B['clean'])} END AS recommendation,
  concat_ws(chr(10), CASE WHEN n_m > 0 THEN {q(_B['missing'])} || array_to_string(m, ', ') END, CASE WHEN n_v > 0 THEN array_to_string(v, chr(10)) END,
    CASE WHEN n_l > 0 THEN {q(_B['low'])} || array_to_string(l, ', ') END, CASE WHEN n = 0 THEN {q(_B['none'])} END) AS issues,
  concat_ws(chr(10), CASE WHEN document_type_label IS NOT NULL THEN {q(_B['template'])} || document_type_label || '.' ELSE {q(_B['no_template'])} END,
    CASE WHEN n_m = 0 THEN {q(_B['ok_required'])} END, CASE WHEN n_v = 0 THEN {q(_B['ok_validation'])} END) AS checks FROM d""")
def reviewer_briefing(t: Tables):
    # a template without a name goes by its key
    named = t.app_documents.withColumn("document_type_label", F.when(F.col("doc_id") % 10 != 0, F.col("document_type_label")))
    b = R.briefings(named, t.stored_fields)
    return b.select("doc_id", "overall_confidence", "document_quality", "summary", "recommendation",
                    F.array_join("issues", "\n").alias("issues"), F.array_join("checks", "\n").alias("checks"))


_BRIEFS = """SELECT event_id AS briefing_id, user_id AS doc_id, <<as_ts:ts>> AS created_at, 'summary ' || event_id AS summary,
  CASE event_id % 4 WHEN 0 THEN '["a","","b ' || event_id || '"]' WHEN 1 THEN 'not json' WHEN 2 THEN '[]' END AS issues_json,
  '["ok"]' AS checks_json FROM """


@query("latest_briefing", f"""
SELECT doc_id, briefing_id, summary, CASE briefing_id % 4 WHEN 0 THEN 'a|b ' || briefing_id ELSE '' END AS issues, 'ok' AS checks FROM (
  SELECT doc_id, unnest(arg_max(b, (created_at, briefing_id))) FROM (SELECT doc_id, created_at, briefing_id, struct_pack(briefing_id := briefing_id,
    summary := summary) AS b FROM ({_BRIEFS} events) x) y GROUP BY doc_id) z""")
def latest_briefing(t: Tables):
    b = R.latest_briefing(t.sql(_BRIEFS + "{events}"))
    return b.select("doc_id", "briefing_id", "summary", F.array_join("issues", "|").alias("issues"),
                    F.array_join("checks", "|").alias("checks"))


@query("review_progress", f"""
SELECT d.doc_id, coalesce(n, 0) AS fields, coalesce(tr, 0) AS to_review, coalesce(un, 0) AS unaccepted, coalesce(ac, 0) AS accepted,
  coalesce(rt, 0) AS required_total, coalesce(rd, 0) AS required_done, coalesce(ex, 0) AS extras,
  CASE WHEN n > 0 THEN CAST(floor(ac * 100 / n + 0.5) AS BIGINT) ELSE 0 END AS percent_accepted,
  CASE WHEN status = 'needs_review' AND n > 0 AND ok = n THEN 'approved' ELSE status END AS effective_status
FROM @app_documents d LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE needs_review) AS tr, count(*) FILTER (WHERE NOT accepted) AS un,
  count(*) FILTER (WHERE accepted) AS ac, count(*) FILTER (WHERE standard_field_key IS NOT NULL AND required) AS rt,
  count(*) FILTER (WHERE standard_field_key IS NOT NULL AND required AND accepted AND NOT needs_review AND {D.blank('display_value')} = false) AS rd,
  count(*) FILTER (WHERE field_name LIKE 'suggested!_extra!_fields.%' ESCAPE '!') AS ex, count(*) FILTER (WHERE accepted AND NOT needs_review) AS ok
  FROM {AUTO} a GROUP BY doc_id) f ON f.doc_id = d.doc_id""")
def review_progress(t: Tables):
    return R.review_progress(t.app_documents, auto_accepted(t))
