"""Search, dashboards and record lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmill import constants as K
from fieldmill.operators import analytics as Q
from workload import duck as D
from workload.registry import TABLES, Tables, query
from workload.review import SCORED, scored

_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _show(df, *names):
    for n in names:
        df = df.withColumn(n, F.date_format(n, _STAMP))
    return df


@query("search_documents", """
SELECT doc_id, filename, status, <<show:created_at>> AS created_at FROM @app_documents d WHERE status = 'needs_review' AND (
  coalesce(filename ILIKE '%mach%', false) OR coalesce(content_type ILIKE '%mach%', false) OR coalesce(parser_type ILIKE '%mach%', false)
  OR coalesce(document_type_key ILIKE '%mach%', false) OR coalesce(document_type_label ILIKE '%mach%', false)
  OR raw_text ILIKE '%mach%' OR coalesce(error_message ILIKE '%mach%', false))
ORDER BY d.created_at DESC, doc_id DESC LIMIT 100""")
def search_documents(t: Tables):
    found = Q.search_documents(t.app_documents, "needs_review", " MACH ", 100)
    return _show(found.select("doc_id", "filename", "status", "created_at"), "created_at")


@query("search_any_text_column", """
SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_name ILIKE '%ring%' OR p_brand ILIKE '%ring%' OR p_type ILIKE '%ring%'
ORDER BY p_partkey DESC LIMIT 40 OFFSET 5""")
def search_any_text_column(t: Tables):
    return Q.search_table(t.part, "p_partkey", "ring", 40, 5).select("p_partkey", "p_name", "p_brand", "p_type")


# The second page: what follows the last id of the first one, which the caller has seen.
@query("search_next_page", """
SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE (p_name ILIKE '%ring%' OR p_brand ILIKE '%ring%' OR p_type ILIKE '%ring%') AND p_partkey <
  (SELECT min(p_partkey) FROM (SELECT p_partkey FROM part WHERE p_name ILIKE '%ring%' OR p_brand ILIKE '%ring%' OR p_type ILIKE '%ring%' ORDER BY p_partkey DESC LIMIT 7) f)
ORDER BY p_partkey DESC LIMIT 9""")
def search_next_page(t: Tables):
    seen = Q.search_table(t.part, "p_partkey", "ring", 7).agg(F.min("p_partkey")).first()[0]
    return Q.search_table(t.part, "p_partkey", "ring", 9, after=seen).select("p_partkey", "p_name", "p_brand", "p_type")


@query("printable_rows", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') <> '000000' THEN '.' || strftime(ts, '%f') ELSE '' END AS ts,
  user_id, '<' || strlen(props) || ' bytes>' AS payload, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day FROM events""")
def printable_rows(t: Tables):
    return Q.printable(t.events.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id",
                                       F.encode("props", "UTF-8").alias("payload"), F.to_date("ts").alias("day")))


# The catalogue speaks of tables, so the query joins it with what the tables hold.
@query("table_catalogue", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, row_number() OVER () - 1 AS position, column_name, (SELECT count(*) FROM {n}) AS table_rows "
    f"FROM (DESCRIBE {n})" for n in TABLES))
def table_catalogue(t: Tables):
    tables = {n: getattr(t, n) for n in TABLES}
    sizes = None
    for n, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("table_rows")).select(F.lit(n).alias("table_name"), "table_rows")
        sizes = one if sizes is None else sizes.unionByName(one)
    return Q.table_catalogue(t.spark, tables).join(sizes, "table_name")


@query("document_view", """
WITH c AS (SELECT field_id, string_agg(correction_id || '=' || corrected_value, ',' ORDER BY correction_id) AS cs FROM @correction_log l GROUP BY field_id),
f AS (SELECT doc_id, string_agg(s.field_id || ':' || extracted_value || '[' || coalesce(cs, '') || ']', ';' ORDER BY s.field_id) AS fields
  FROM @stored_fields s LEFT JOIN c ON c.field_id = s.field_id GROUP BY doc_id),
j AS (SELECT doc_id, string_agg(job_id || ':' || status, ';' ORDER BY job_id) AS jobs FROM @jobs x GROUP BY doc_id),
b AS (SELECT doc_id, string_agg(event_id || ':' || details, ';' ORDER BY event_id) AS briefings FROM @audit_log a WHERE action = 'view' GROUP BY doc_id)
SELECT d.doc_id, 0 AS page, filename, coalesce(fields, '') AS fields, coalesce(jobs, '') AS jobs, coalesce(briefings, '') AS briefings FROM @app_documents d
LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN j ON j.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id""")
def document_view(t: Tables):
    briefs = t.audit_log.filter("action = 'view' and doc_id is not null").select(
        F.col("event_id").alias("briefing_id"), "doc_id", F.col("details").alias("summary"))
    v = Q.document_view(t.app_documents.select("doc_id", "filename"), t.stored_fields, t.correction_log, t.jobs, briefs)
    text = lambda c, fn: F.coalesce(F.array_join(F.transform(c, fn), ";"), F.lit(""))
    history = lambda f: F.coalesce(F.array_join(F.transform(f["corrections"], lambda x: F.concat(
        x["correction_id"].cast("string"), F.lit("="), x["corrected_value"])), ","), F.lit(""))
    return v.select("doc_id", "page", "filename", text("fields", lambda f: F.concat(
        f["field_id"].cast("string"), F.lit(":"), f["extracted_value"], F.lit("["), history(f), F.lit("]"))).alias("fields"),
        text("jobs", lambda j: F.concat(j["job_id"].cast("string"), F.lit(":"), j["status"])).alias("jobs"),
        text("briefings", lambda b: F.concat(b["briefing_id"].cast("string"), F.lit(":"), b["summary"])).alias("briefings"))


@query("audit_trail", "SELECT event_id, doc_id, action, actor, <<show:created_at>> AS created_at FROM @audit_log a")
def audit_trail(t: Tables):
    return _show(Q.audit_trail(t.audit_log).drop("details"), "created_at")


_NULLED = "SELECT event_id, doc_id, action, actor, CASE WHEN event_id % 6 > 0 THEN created_at END AS created_at FROM "


@query("latest_action", f"""
SELECT d.doc_id, a.action AS latest_action, a.actor AS latest_actor, <<show:a.created_at>> AS latest_at FROM @app_documents d LEFT JOIN (
  SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY x.doc_id ORDER BY coalesce(x.created_at, y.created_at) DESC, event_id DESC) AS rn
  FROM ({_NULLED} @audit_log n) x JOIN @app_documents y ON y.doc_id = x.doc_id) r WHERE rn = 1) a ON a.doc_id = d.doc_id""")
def latest_action(t: Tables):
    from workload.registry import INPUTS
    log = t.sql(_NULLED + "(" + INPUTS["audit_log"] + ") n")
    return _show(Q.latest_action(t.app_documents.select("doc_id", "created_at"), log), "latest_at").drop("created_at")


@query("status_counts", f"""
SELECT s AS status, (SELECT count(*) FROM @app_documents d WHERE status = s) AS documents
FROM (VALUES {', '.join(f"('{s}')" for s in K.DOCUMENT_STATUSES)}) v(s)""")
def status_counts(t: Tables):
    return Q.status_counts(t.app_documents)


@query("parser_counts", """
SELECT coalesce(parser_type, 'unknown') AS parser_type, count(*) AS documents FROM @app_documents d GROUP BY 1""")
def parser_counts(t: Tables):
    return Q.parser_counts(t.app_documents)


@query("field_metrics", """
SELECT (SELECT count(*) FROM @stored_fields s) AS total_fields, (SELECT count(*) FROM @stored_fields s WHERE accepted) AS accepted_fields,
  (SELECT count(*) FROM @stored_fields s WHERE needs_review) AS needs_review_fields, (SELECT count(*) FROM @correction_log c) AS corrections,
  (SELECT count(*) FROM @audit_log a WHERE action = 'field_manually_added') AS manually_added""")
def field_metrics(t: Tables):
    return Q.field_metrics(t.stored_fields, t.correction_log, t.audit_log)


@query("average_confidence")
def average_confidence(t: Tables):
    return Q.average_confidence(scored(t))


@query("average_confidence_edit", f"""
SELECT {D.mean_units('confidence', 4)} / 10000 AS avg_confidence, {D.mean_units('review_confidence', 4)} / 10000 AS avg_review_confidence
FROM {SCORED} s""")
def average_confidence_edit(t: Tables):
    return Q.average_confidence(scored(t, "levenshtein"))


@query("review_queue", """
WITH d AS (SELECT * FROM @app_documents x WHERE status = 'needs_review' ORDER BY updated_at DESC, doc_id DESC LIMIT 5)
SELECT d.doc_id, coalesce(filename, 'Raw text document #' || d.doc_id) AS filename, status, <<show:updated_at>> AS updated_at,
  (SELECT count(*) FROM @stored_fields s WHERE s.doc_id = d.doc_id AND (needs_review OR NOT accepted)) AS blocking_fields FROM d""")
def review_queue(t: Tables):
    return _show(Q.review_queue(t.app_documents, t.stored_fields), "updated_at")


@query("recent_activity", """
SELECT a.event_id, a.doc_id, CASE WHEN filename IS NOT NULL THEN filename WHEN a.doc_id IS NOT NULL THEN 'Document #' || a.doc_id ELSE 'System' END AS filename,
  parser_type, status AS document_status, action, actor, details, <<show:a.created_at>> AS created_at
FROM (SELECT * FROM @audit_log x ORDER BY created_at DESC, event_id DESC LIMIT 10) a LEFT JOIN @app_documents d ON d.doc_id = a.doc_id""")
def recent_activity(t: Tables):
    return _show(Q.recent_activity(t.audit_log, t.app_documents), "created_at")


@query("record_stats", f"""
SELECT count(*) AS total, {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in K.DOCUMENT_STATUSES)} FROM @app_documents d""")
def record_stats(t: Tables):
    return Q.record_stats(t.app_documents)


@query("record_list")
def record_list(t: Tables):
    return Q.record_list(t.app_documents, scored(t))


@query("record_list_edit", f"""
SELECT d.doc_id, d.status, coalesce(n, 0) AS fields, review_percent FROM @app_documents d LEFT JOIN (SELECT doc_id, count(*) AS n,
  {D.mean_units('review_confidence', 2)} AS review_percent FROM {SCORED} s GROUP BY doc_id) f
ON f.doc_id = d.doc_id""")
def record_list_edit(t: Tables):
    return Q.record_list(t.app_documents, scored(t, "levenshtein"))


@query("client_stats", """
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'approved') AS approved, count(*) FILTER (WHERE status = 'needs_review'
  OR EXISTS (SELECT 1 FROM @stored_fields s WHERE s.doc_id = d.doc_id AND s.needs_review)) AS needs_review,
  count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'error') AS error,
  count(*) FILTER (WHERE status = 'rejected') AS rejected FROM @app_documents d""")
def client_stats(t: Tables):
    return Q.client_stats(t.app_documents, t.stored_fields)


@query("concat_search", """
SELECT doc_id FROM @app_documents d WHERE status = 'approved' AND contains(lower(concat_ws(' ', coalesce(filename, 'Raw text document #' || doc_id),
  coalesce(content_type, ''), parser_type, raw_text)), '#1')""")
def concat_search(t: Tables):
    return Q.concat_search(t.app_documents, " #1", "approved").select("doc_id")


_KEYS = ["invoice_number", "supplier_name", "total_amount", "invoice_date"]


@query("fields_pivot", "SELECT doc_id, " + ", ".join(
    f"arg_max(value, (confidence, -pos)) FILTER (WHERE standard_field_key = '{k}') AS {k}" for k in _KEYS)
    + " FROM @stored_fields s WHERE standard_field_key IS NOT NULL GROUP BY doc_id")
def fields_pivot(t: Tables):
    return Q.fields_pivot(t.stored_fields, _KEYS)
