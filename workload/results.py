"""Model responses, prompts, cache, quota and retry tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmill import constants as K
from fieldmill.operators import results as A
from workload.registry import Tables, q, query

_GOOD = "doc_id % 5 IN (0, 1, 3)"


@query("lenient_json_object", """
SELECT doc_id, CASE WHEN inner_ok THEN regexp_extract(response, '(?s)\\{.*\\}') END AS object FROM (
  SELECT *, json_valid(regexp_extract(response, '(?s)\\{.*\\}')) AS inner_ok FROM @responses r) x""")
def lenient_json_object(t: Tables):
    return t.responses.select("doc_id", A.lenient_json_object(F.col("response")).alias("object"))


@query("normalise_model_fields", f"""
WITH o AS (SELECT doc_id, provider, model, price, customer, regexp_extract(response, '(?s)\\{{.*\\}}') AS j FROM @responses r WHERE {_GOOD}),
i AS (SELECT doc_id, provider, model, CAST(e.key AS INT) AS pos, e.value AS item FROM o, json_each(o.j, '$.fields') e WHERE e.type = 'OBJECT'),
v AS (SELECT doc_id, provider, model, pos, trim(coalesce(item->>'field_name', item->>'name', '')) AS field_name,
  trim(coalesce(CASE WHEN json_exists(item, '$.value') THEN item->>'value' ELSE item->>'extracted_value' END, '')) AS value,
  coalesce(try_cast(coalesce(item->>'confidence', item->>'confidence_score') AS DOUBLE), 0.7) AS c,
  item->>'source_snippet' AS s, coalesce(item->>'explanation', item->>'reasoning', {q(K.MODEL_DEFAULT_EXPLANATION)}) AS explanation FROM i)
SELECT doc_id, provider, model, pos, field_name, value, round(CASE WHEN c > 1 THEN least(1, c / 100) ELSE greatest(0, c) END, 4) AS confidence,
  coalesce(s, value) AS source_snippet, explanation FROM v WHERE field_name <> '' AND value <> ''""")
def normalise_model_fields(t: Tables):
    return A.model_fields(t.responses)


@query("unusable_responses", f"SELECT doc_id, {q(K.MODEL_OBJECT_ERROR)} AS error FROM @responses r WHERE NOT ({_GOOD})")
def unusable_responses(t: Tables):
    return A.unusable_responses(t.responses)


@query("normalise_model_review", f"""
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN {q(K.REVIEW_DEFAULT_SUMMARY)} ELSE 'Order ' || doc_id END AS summary,
  CASE WHEN doc_id % 4 = 3 THEN 0 WHEN doc_id % 130 > 1 THEN round(least(1, CAST(doc_id % 130 AS DOUBLE) / 100), 4) ELSE doc_id % 130 END AS overall_confidence,
  CASE WHEN doc_id % 4 = 3 THEN 'unknown' ELSE 'needs_review' END AS document_quality, {q(K.REVIEW_DEFAULT_RECOMMENDATION)} AS recommendation,
  CASE WHEN doc_id % 4 = 3 THEN '' ELSE CASE doc_id % 3 WHEN 0 THEN 'late|' || customer WHEN 1 THEN 'one only' ELSE '' END END AS issues,
  CASE WHEN doc_id % 4 = 3 THEN '' ELSE 'sum ok' END AS checks FROM @review_responses r""")
def normalise_model_review(t: Tables):
    return A.model_reviews(t.review_responses).select(
        "doc_id", "summary", "overall_confidence", "document_quality", "recommendation",
        F.array_join("issues", "|").alias("issues"), F.array_join("checks", "|").alias("checks"))


@query("prompt_table", f"""
WITH l AS (SELECT doc_id, string_agg('{{"field_name":"' || field_name || '","standard_field_key":' || coalesce('"' || standard_field_key || '"', 'null')
    || ',"value":"' || value || '","confidence":' || confidence || ',"required":' || required || ',"data_type":"' || data_type || '"}}', chr(10) ORDER BY pos, field_name) AS lines FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, field_name) AS rn FROM @stored_fields s) x WHERE rn <= 80 GROUP BY doc_id)
SELECT 'extract' AS kind, doc_id, 'Parser type: plain_text' || chr(10) || chr(10) || 'Document text:' || chr(10) || '---' || chr(10) || left('Be exact.'
  || chr(10) || chr(10) || 'Document content:' || chr(10) || text, 12000) || chr(10) || '---' || chr(10) || chr(10) || 'Extract the fields now. Return JSON only.' AS prompt FROM documents
UNION ALL SELECT 'review', d.doc_id, 'Review this processed document package and produce a reviewer briefing.' || chr(10) || chr(10) || 'Context:' || chr(10) || '---' || chr(10)
  || left('Document id: ' || d.doc_id || chr(10) || 'Filename: ' || coalesce(filename, 'None') || chr(10) || 'Parser: ' || coalesce(parser_type, 'none') || chr(10)
  || 'Extraction mode: ' || extraction_mode || chr(10) || 'Template: ' || coalesce(document_type_label, 'None') || chr(10) || 'Extraction strategy: deterministic'
  || chr(10) || chr(10) || 'Original parsed document text:' || chr(10) || raw_text || chr(10) || chr(10) || 'Extracted/template fields:' || chr(10) || coalesce(lines, ''), 14000)
  || chr(10) || '---' || chr(10) || chr(10) || 'Return JSON only.' FROM @app_documents d LEFT JOIN l ON l.doc_id = d.doc_id""")
def prompt_table(t: Tables):
    docs = t.documents.select("doc_id", F.lit("plain_text").alias("parser_type"), F.col("text").alias("raw_text"),
                              F.lit("Be exact.").alias("contract"))
    apps = t.app_documents.withColumn("parser_type", F.coalesce("parser_type", F.lit("none")))
    review = A.review_prompts(apps, t.stored_fields)
    return A.extraction_prompts(docs).select(F.lit("extract").alias("kind"), "*").unionByName(
        review.select(F.lit("review").alias("kind"), "*"))


_KEYED = """SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'raw_text' WHEN 1 THEN 'plain_text' ELSE 'pdf_text' END AS parser_type,
  CASE WHEN doc_id % 2 = 0 THEN 'finance_invoice' END AS template_key FROM """
_KEY = """sha256(sha256(text) || ':' || parser_type || coalesce(':template:' || template_key, '') || ':p1:m1')"""


def keyed(t: Tables):
    return t.sql(_KEYED + "{documents}").select("doc_id", "parser_type", "text", A.cache_key(
        F.sha2("text", 256), F.col("parser_type"), F.col("template_key"), F.lit("p1"), F.lit("m1")).alias("cache_key"))


@query("cache_key", f"SELECT doc_id, {_KEY} AS cache_key FROM ({_KEYED} documents) k")
def cache_key(t: Tables):
    return keyed(t).select("doc_id", "cache_key")


@query("model_eligible", f"SELECT doc_id FROM ({_KEYED} documents) k WHERE parser_type IN ('raw_text', 'markdown', 'pdf_text')")
def model_eligible(t: Tables):
    return A.model_eligible(keyed(t)).select("doc_id")


# Cached are the contents of the documents that carry a quality label.
_REQ = f"(SELECT doc_id, sha256(text) AS cache_key, text FROM documents)"
_CACHE = f"""(SELECT cache_key, min(left(text, 40)) AS fields, 1 AS use_count, TIMESTAMP '2024-01-01 00:00:00' AS last_used_at
  FROM {_REQ} r WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY cache_key)"""
def _now():
    return F.lit("2024-06-01 12:00:00").cast("timestamp")


def cache(t: Tables):
    known = requests(t).join(t.labels.select("doc_id"), "doc_id", "left_semi")
    return known.groupBy("cache_key").agg(F.min(F.left("text", F.lit(40))).alias("fields")).select(
        "cache_key", "fields", F.lit(1).alias("use_count"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("last_used_at"))


def requests(t: Tables):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("cache_key"), "text")


@query("cache_lookup", f"""
SELECT 'request' AS kind, r.cache_key, doc_id, c.cache_key IS NOT NULL AS hit, fields, NULL AS n, NULL AS last_used_at FROM {_REQ} r LEFT JOIN {_CACHE} c ON c.cache_key = r.cache_key
UNION ALL SELECT 'miss', cache_key, min(doc_id), NULL, NULL, count(*), NULL FROM {_REQ} r WHERE cache_key NOT IN (SELECT cache_key FROM {_CACHE} c) GROUP BY cache_key
UNION ALL SELECT 'cache', c.cache_key, NULL, NULL, any_value(fields), any_value(use_count) + count(r.doc_id), CASE WHEN count(r.doc_id) > 0 THEN
  '2024-06-01 12:00:00' ELSE '2024-01-01 00:00:00' END FROM {_CACHE} c LEFT JOIN {_REQ} r ON r.cache_key = c.cache_key GROUP BY c.cache_key""")
def cache_lookup(t: Tables):
    req, stored = requests(t).drop("text"), cache(t)
    hits = A.cache_lookup(req, stored).select(F.lit("request").alias("kind"), "cache_key", "doc_id", "hit", "fields")
    miss = A.cache_misses(req, stored).select(F.lit("miss").alias("kind"), "cache_key", "doc_id", F.col("requests").alias("n"))
    touched = A.cache_touch(stored, req, _now()).select(
        F.lit("cache").alias("kind"), "cache_key", "fields", F.col("use_count").alias("n"),
        F.date_format("last_used_at", "yyyy-MM-dd HH:mm:ss").alias("last_used_at"))
    return hits.unionByName(miss, allowMissingColumns=True).unionByName(touched, allowMissingColumns=True)


_NEW = f"(SELECT cache_key, 'new ' || min(doc_id) AS fields FROM {_REQ} r WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY cache_key)"


@query("cache_upsert", f"""
SELECT coalesce(c.cache_key, n.cache_key) AS cache_key, coalesce(n.fields, c.fields) AS fields,
  coalesce(use_count, 0) + CASE WHEN n.cache_key IS NOT NULL THEN 1 ELSE 0 END AS use_count,
  CASE WHEN c.cache_key IS NULL THEN NULL WHEN n.cache_key IS NOT NULL THEN '2024-06-01 12:00:00' ELSE '2024-01-01 00:00:00' END AS last_used_at
FROM {_CACHE} c FULL JOIN {_NEW} n ON n.cache_key = c.cache_key""")
def cache_upsert(t: Tables):
    new = requests(t).join(t.labels.select("doc_id"), "doc_id", "left_anti").groupBy("cache_key").agg(
        F.concat(F.lit("new "), F.min("doc_id").cast("string")).alias("fields"))
    return A.cache_upsert(cache(t), new, _now()).withColumn(
        "last_used_at", F.date_format("last_used_at", "yyyy-MM-dd HH:mm:ss"))


# Admission as a sequence of two rankings, unlike the engine's per-minute counts.
ADMITTED = """(SELECT r.*, coalesce(d.dn <= 30, false) AS admitted, CASE WHEN coalesce(d.dn <= 30, false) THEN NULL WHEN r.mn > 1 AND r.first_ok THEN 'minute' ELSE 'day' END AS refused_by FROM (
  SELECT m.*, coalesce(bool_or(x.dn <= 30) OVER (PARTITION BY m.provider, m.model, m.minute), false) AS first_ok FROM
    (SELECT *, date_trunc('minute', ts) AS minute, row_number() OVER (PARTITION BY provider, model, date_trunc('minute', ts) ORDER BY ts, request_id) AS mn
     FROM @requests q) m LEFT JOIN (SELECT request_id, row_number() OVER (PARTITION BY provider, model, date_trunc('day', ts) ORDER BY ts, request_id) AS dn
     FROM (SELECT *, row_number() OVER (PARTITION BY provider, model, date_trunc('minute', ts) ORDER BY ts, request_id) AS mn FROM @requests q) f WHERE mn = 1) x
    ON x.request_id = m.request_id) r LEFT JOIN (SELECT request_id, row_number() OVER (PARTITION BY provider, model, date_trunc('day', ts)
     ORDER BY ts, request_id) AS dn FROM (SELECT *, row_number() OVER (PARTITION BY provider, model, date_trunc('minute', ts) ORDER BY ts, request_id) AS mn
     FROM @requests q) f WHERE mn = 1) d ON d.request_id = r.request_id)"""


def admitted(t: Tables):
    return A.quota_admission(t.requests, minute_limit=1, day_limit=30)


@query("quota_admission", f"SELECT request_id, admitted, refused_by FROM {ADMITTED} a")
def quota_admission(t: Tables):
    return admitted(t).select("request_id", "admitted", "refused_by")


@query("quota_window_counts", f"""
SELECT provider, model, 'minute' AS window_type, <<show:date_trunc('minute', ts)>> AS window_start, count(*) AS request_count, 1 AS limit_count
FROM {ADMITTED} a WHERE admitted GROUP BY provider, model, date_trunc('minute', ts)
UNION ALL SELECT provider, model, 'day', <<show:CAST(date_trunc('day', ts) AS TIMESTAMP)>>, count(*), 30 FROM {ADMITTED} a WHERE admitted
GROUP BY provider, model, date_trunc('day', ts)""")
def quota_window_counts(t: Tables):
    w = A.quota_windows(admitted(t).filter("admitted"), 1, 30)
    return w.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("retry_schedule", f"""
SELECT request_id, <<show:reset_at>> AS reset_at, greatest(60, CAST(floor((epoch_us(reset_at) - epoch_us(ts)) / 1000000) AS BIGINT)) AS wait_seconds
FROM (SELECT *, CASE WHEN refused_by = 'minute' THEN date_trunc('minute', ts) + INTERVAL 65 SECOND ELSE CAST(date_trunc('day', ts) AS TIMESTAMP)
  + INTERVAL 86405 SECOND END AS reset_at FROM {ADMITTED} a WHERE NOT admitted) r""")
def retry_schedule(t: Tables):
    r = A.retry_schedule(admitted(t).filter("not admitted"))
    return r.select("request_id", F.date_format("reset_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("reset_at"), "wait_seconds")
