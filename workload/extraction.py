"""Tokens, classes, snippets and labelled values of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmill import constants as K
from fieldmill.catalogue import Catalogue
from fieldmill.functions import labels as L, text as T
from fieldmill.functions.common import normalize_key
from fieldmill.operators import templates as TP
from fieldmill.operators.analytics import run_metadata as run_metadata_of
from workload import duck as D
from workload.registry import Tables, q, query



@query("classify_document", f"""
SELECT doc_id, {D.classify('low', 'parser_type', 0)} AS type, {D.classify('low', 'parser_type', 1)} AS confidence,
  {D.classify('low', 'parser_type', 2)} AS reason
FROM (SELECT doc_id, lower(text) AS low, CASE doc_id % 6 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'pdf_text'
  ELSE 'plain_text' END AS parser_type FROM @all_texts a) d""")
def classify_document(t: Tables):
    parser = F.expr("CASE doc_id % 6 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'pdf_text' "
                    "ELSE 'plain_text' END")
    return t.all_texts.select("doc_id", T.classify(F.lower(F.col("text")), parser).alias("c")).select("doc_id", "c.*")


@query("extractive_summary", f"""
SELECT doc_id, summary, CAST(CASE WHEN summary <> '' THEN 0.7 ELSE 0.4 END AS DOUBLE) AS confidence
FROM (SELECT doc_id, {D.summary('text')} AS summary FROM @all_texts a) s""")
def extractive_summary(t: Tables):
    return t.all_texts.select("doc_id", T.summary(F.col("text")).alias("summary")).withColumn(
        "confidence", F.when(F.col("summary") != "", 0.7).otherwise(0.4))


def _token(name: str, pattern: str, fn):
    @query(name, f"SELECT doc_id, v AS value FROM (SELECT doc_id, {D.find('text', pattern)} AS v "
                 "FROM @all_texts a) s WHERE v <> ''")
    def run(t: Tables):
        return t.all_texts.select("doc_id", fn(F.col("text")).alias("value")).filter("value <> ''")


_token("extract_email", K.EMAIL_FIND, T.first_email)
_token("extract_amount", K.AMOUNT_FIND, T.first_amount)
_token("extract_date", K.DATE_FIND, T.first_date)
_token("extract_phone_or_reference", K.PHONE_FIND, T.first_phone)


@query("context_snippet", f"""
SELECT doc_id, {D.snippet('text', 'v')} AS snippet FROM (
  SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'NOT THERE' ELSE {D.find('text', K.AMOUNT_FIND)} END AS v
  FROM @all_texts a) s""")
def context_snippet(t: Tables):
    value = F.when(F.col("doc_id") % 3 == 0, "NOT THERE").otherwise(T.first_amount(F.col("text")))
    return t.all_texts.select("doc_id", T.snippet(F.col("text"), value).alias("snippet"))


_FOUND = " + ".join(f"CAST({D.find('text', p)} <> '' AS INT)" for p in (
    K.EMAIL_FIND, K.AMOUNT_FIND, K.DATE_FIND, K.PHONE_FIND))


@query("manual_review_reason", f"""
SELECT doc_id, {q(K.NO_FIELDS_VALUE)} AS value, CAST(0.48 AS DOUBLE) AS confidence, left(text, 220) AS snippet
FROM @all_texts a WHERE {_FOUND} = 0""")
def manual_review_reason(t: Tables):
    fields = t.all_texts.select("doc_id", F.inline(T.generic_fields(F.col("text"), F.col("parser_type"))))
    return fields.filter("field_name = 'needs_manual_review_reason'").select(
        "doc_id", "value", "confidence", "snippet")


def _generic(texts: str) -> str:
    """Oracle for the generic fields of (doc_id, text, low, parser_type)."""
    parts = [
        f"SELECT doc_id, 0 AS p, 'document_type' AS field_name, {D.classify('low', 'parser_type', 0)} AS value, "
        f"{D.classify('low', 'parser_type', 1)} AS confidence, left(text, 160) AS snippet, "
        f"{D.classify('low', 'parser_type', 2)} AS reasoning FROM {texts} d",
        f"SELECT doc_id, 1, 'summary', s, CAST(CASE WHEN s <> '' THEN 0.7 ELSE 0.4 END AS DOUBLE), left(s, 220), "
        f"{q(K.SUMMARY_REASON)} FROM (SELECT doc_id, {D.summary('text')} AS s FROM {texts} d) x"]
    for i, (name, pattern, confidence, why) in enumerate([
            ("email", K.EMAIL_FIND, 0.92, K.EMAIL_REASON), ("amount", K.AMOUNT_FIND, 0.84, K.AMOUNT_REASON),
            ("date", K.DATE_FIND, 0.8, K.DATE_REASON),
            ("phone_or_reference_number", K.PHONE_FIND, 0.66, K.PHONE_REASON)]):
        parts.append(
            f"SELECT doc_id, {i + 2}, {q(name)}, v, CAST({confidence} AS DOUBLE), {D.snippet('text', 'v')}, {q(why)} "
            f"FROM (SELECT doc_id, text, {D.find('text', pattern)} AS v FROM {texts} d) x WHERE v <> ''")
    parts.append(f"SELECT doc_id, 6, 'needs_manual_review_reason', {q(K.NO_FIELDS_VALUE)}, CAST(0.48 AS DOUBLE), "
                 f"left(text, 220), {q(K.NO_FIELDS_REASON)} FROM {texts} d WHERE {_FOUND} = 0")
    return "(" + " UNION ALL ".join(parts) + ")"


@query("deterministic_fields", "WITH docs AS MATERIALIZED (SELECT *, lower(text) AS low FROM @all_texts a) "
       f"SELECT doc_id, field_name, value, confidence, snippet, reasoning FROM {_generic('docs')} g")
def deterministic_fields(t: Tables):
    return t.all_texts.select("doc_id", F.inline(T.generic_fields(F.col("text"), F.col("parser_type")))).select(
        "doc_id", "field_name", "value", "confidence", "snippet", "reasoning")


@query("line_table", f"""
SELECT doc_id, line_no AS line, start_char AS start, line AS text
FROM {D.line_rows("(SELECT doc_id, 'x' AS template, text FROM @all_texts a)")} r""")
def line_table(t: Tables):
    return t.all_texts.select("doc_id", F.inline(T.line_table(F.col("text"))))


_KINDS = """CASE doc_id % 4 WHEN 0 THEN 'finance_invoice' WHEN 1 THEN 'construction_purchase_order'
  WHEN 2 THEN 'construction_progress_claim' ELSE 'finance_bank_statement' END"""


@query("labelled_values", f"""
SELECT doc_id, fkey AS field_name, value, line_no AS line, start_char AS start, end_char AS "end", left(line, 500) AS snippet,
  'Deterministically extracted from labelled source line using template label/alias "' || label || '".' AS reasoning
FROM {D.labelled(f"(SELECT doc_id, text, {_KINDS} AS template FROM @all_texts a)")} l""")
def labelled_values(t: Tables):
    docs = t.all_texts.withColumn("template_key", F.expr(_KINDS)).join(
        F.broadcast(Catalogue.bundled().profiles(t.spark)), "template_key", "left")
    found = docs.select("doc_id", F.inline(T.labelled_fields(
        F.col("text"), F.col("template_key"), F.col("labels"), F.col("template_fields"))))
    return found.select("doc_id", "field_name", "value", "source.line", "source.start", "source.end", "snippet",
                        "reasoning")


# Labels and keys come from the part table: every part name and type is a label of its own. Longest first, then as given.
@query("label_variants", f"""
SELECT p_partkey, string_agg(x, '|' ORDER BY length(x) DESC, i) AS labels FROM (SELECT p_partkey, x, min(i) AS i FROM (
  SELECT p_partkey, unnest([lower(p_type), lower(trim(regexp_replace(replace(p_name, '_', ' '), '\\s+', ' ', 'g'))), lower(p_brand), left(lower(p_type), length(p_brand))]) AS x,
    unnest([0, 1, 2, 3]) AS i FROM part) a GROUP BY p_partkey, x) b WHERE x <> '' GROUP BY p_partkey""")
def label_variants(t: Tables):
    from fieldmill.catalogue import label_variants as variants
    labels = variants(F.col("p_name"), F.col("p_type"), F.array(F.col("p_brand"), F.left("p_type", F.length("p_brand"))))
    return t.part.select("p_partkey", F.array_join(labels, "|").alias("labels"))


@query("normalize_key", f"""
SELECT p_partkey, {D.label_key("p_name")} AS name_key, {D.label_key("p_brand || ' % ' || p_type || '.'")} AS mixed_key
FROM part""")
def normalize_key_query(t: Tables):
    return t.part.select("p_partkey", normalize_key(F.col("p_name")).alias("name_key"), normalize_key(
        F.concat("p_brand", F.lit(" % "), "p_type", F.lit("."))).alias("mixed_key"))


_SPAN_INPUT = """
SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id % 40 AS INT) END AS s,
  CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id % 90 AS INT) END AS e,
  CASE doc_id % 4 WHEN 0 THEN 'invoice   DATE:' WHEN 1 THEN ' total: RM ' WHEN 2 THEN substr(replace(text, chr(10), '  '), 40, 30) ELSE '' END AS snip,
  CASE doc_id % 3 WHEN 0 THEN 'nothing' WHEN 1 THEN 'MEETING' ELSE '' END AS shown, 'claim no' AS found FROM """


@query("locate_source_span", f"""
WITH d AS (SELECT *, length(text) AS n, greatest(0, least(length(text), s)) AS lo FROM ({_SPAN_INPUT} @all_texts a) z),
f AS (SELECT doc_id, text, n, lo, greatest(lo, least(n, e)) AS hi, s, e, {', '.join(
  f"CASE WHEN {D.strip(c)} = '' THEN -1 WHEN strpos(lower(text), lower({D.strip(c)})) > 0 "
  f"THEN strpos(lower(text), lower({D.strip(c)})) - 1 WHEN regexp_matches(text, '(?i)' || pat_{c}) "
  f"THEN length(regexp_extract(text, '(?is)^(.*?)' || pat_{c}, 1)) ELSE -1 END AS a_{c}, length({D.strip(c)}) AS w_{c}"
  for c in ('snip', 'shown', 'found'))}
  FROM (SELECT *, {', '.join(f"regexp_replace({D.strip(c)}, '[[:space:]]+', '[[:space:]]+', 'g') AS pat_{c}" for c in ('snip', 'shown', 'found'))} FROM d) p)
SELECT doc_id, matched, start, "end", CASE WHEN matched THEN left(text, start) ELSE text END AS before,
  CASE WHEN matched THEN substr(text, start + 1, "end" - start) ELSE '' END AS hit, CASE WHEN matched THEN substr(text, "end" + 1) ELSE '' END AS after FROM (
SELECT doc_id, text, (s IS NOT NULL AND hi > lo) OR a_snip >= 0 OR a_shown >= 0 OR a_found >= 0 AS matched,
  CASE WHEN s IS NOT NULL AND hi > lo THEN lo WHEN a_snip >= 0 THEN a_snip WHEN a_shown >= 0 THEN a_shown
    WHEN a_found >= 0 THEN a_found END AS start,
  CASE WHEN s IS NOT NULL AND hi > lo THEN hi WHEN a_snip >= 0 THEN least(n, a_snip + w_snip)
    WHEN a_shown >= 0 THEN least(n, a_shown + w_shown) WHEN a_found >= 0 THEN least(n, a_found + w_found) END AS "end"
FROM f) g""")
def locate_source_span(t: Tables):
    from workload.registry import INPUTS
    d = t.sql(_SPAN_INPUT + "(" + INPUTS["all_texts"] + ") a")
    return d.select("doc_id", L.source_span(F.col("text"), *[F.col(c) for c in ("s", "e", "snip", "shown", "found")])
                    .alias("x")).select("doc_id", "x.*")


@query("confidence_tier", """
SELECT field_id, CASE WHEN confidence >= 0.9 THEN 'High' WHEN confidence >= 0.8 THEN 'Medium' ELSE 'Low' END AS tier
FROM @raw_fields f""")
def confidence_tier(t: Tables):
    return t.raw_fields.select("field_id", L.confidence_tier(F.col("confidence")).alias("tier"))


@query("run_metadata", f"""
SELECT doc_id, trim(regexp_extract(why, {q(K.RUN_METADATA)}, 1)) AS provider,
  trim(regexp_extract(why, {q(K.RUN_METADATA)}, 2)) AS model, trim(regexp_replace(why, {q(K.RUN_PREFIX)}, '')) AS reason
FROM (SELECT doc_id, arg_min(reasoning, field_id) AS why FROM @stored_fields f
      WHERE regexp_matches(reasoning, {q(K.RUN_METADATA)}) GROUP BY doc_id) r""")
def run_metadata(t: Tables):
    fields = t.stored_fields
    reason = fields.filter(F.rlike("reasoning", F.lit(K.RUN_METADATA))).groupBy("doc_id").agg(
        L.clean_reason(F.min_by("reasoning", "field_id")).alias("reason"))
    return run_metadata_of(fields).join(reason, "doc_id")


@query("record_preview", f"""
SELECT doc_id, array_to_string(list_transform((list_filter(string_split_regex({D.strip('text')}, '\\r?\\n'),
  lambda l: l <> ''))[1:51], lambda l: array_to_string(list_transform(string_split(l, ','),
  lambda c: {D.strip('c')}), '|')), chr(10)) AS preview FROM @all_texts a""")
def record_preview(t: Tables):
    rows = F.transform(L.record_preview(F.col("text")), lambda r: F.array_join(r, "|"))
    return t.all_texts.select("doc_id", F.array_join(rows, "\n").alias("preview"))


@query("display_labels", """
SELECT doc_id, replace(status, '_', ' ') AS status_label,
  coalesce(CASE parser_type WHEN 'raw_text' THEN 'Text preview' WHEN 'markdown' THEN 'Markdown/text preview'
    WHEN 'pdf_text' THEN 'PDF text preview' WHEN 'json' THEN 'Pretty JSON preview' WHEN 'csv' THEN 'CSV table preview' END,
    parser_type || ' preview') AS parser_label,
  CASE extraction_mode WHEN 'auto_detect' THEN 'Auto-detect template' WHEN 'discovery' THEN 'Free Extraction'
    WHEN 'template' THEN 'Selected template' ELSE 'Unknown' END AS mode_label,
  coalesce(filename, 'Raw text document #' || doc_id) AS file_label, CAST(doc_id % 101 AS BIGINT) || '%' AS share
FROM @app_documents d""")
def display_labels(t: Tables):
    return t.app_documents.select(
        "doc_id", L.spaced(F.col("status")).alias("status_label"),
        L.parser_label(F.col("parser_type")).alias("parser_label"),
        L.mode_label(F.col("extraction_mode")).alias("mode_label"),
        L.file_label(F.col("filename"), F.col("doc_id")).alias("file_label"),
        L.percent_label((F.col("doc_id") % 101) / 100).alias("share"))
