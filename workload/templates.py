"""Template choice and the template contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmill import constants as K
from fieldmill.catalogue import Catalogue
from fieldmill.functions.common import normalize_key
from fieldmill.operators import catalog, templates as TP
from workload import duck as D
from workload.ingest import _DEFINED, definitions
from workload.registry import Tables, q, query

BUNDLED = Catalogue.bundled()
_LOW = "(SELECT doc_id, lower(text) AS low FROM @all_texts a)"


@query("infer_template", f"SELECT doc_id, template AS template_key, score FROM {D.inferred(_LOW)} i")
def infer_template(t: Tables):
    best = F.array_max(TP.template_scores(F.lower("text"), BUNDLED))
    # inline() keeps the expression in one place; a filter on it would be evaluated a second time
    hit = F.filter(F.array(best), lambda b: b["score"] >= 2)
    return t.all_texts.select("doc_id", F.inline(hit)).select(
        "doc_id", F.col("key").alias("template_key"), "score")


_MODES = """SELECT doc_id, text AS raw_text, CASE doc_id % 7 WHEN 0 THEN 'csv' ELSE parser_type END AS parser_type,
  CASE doc_id % 3 WHEN 0 THEN 'discovery' WHEN 1 THEN 'auto_detect' ELSE 'template' END AS extraction_mode,
  CASE WHEN doc_id % 3 = 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'finance_invoice' ELSE 'own_kind' END END AS document_type_key,
  CASE WHEN doc_id % 3 = 2 THEN 'asked' END AS document_type_label FROM """
_NAMES = "CASE " + " ".join(f"WHEN key = {q(t.key)} THEN {q(t.name)}" for t in BUNDLED.templates) + " ELSE key END"


@query("resolve_mode", f"""
WITH d AS (SELECT * FROM ({_MODES} @all_texts a) m), i AS (SELECT * FROM {D.inferred("(SELECT doc_id, lower(raw_text) AS low FROM d)")} x),
r AS (SELECT d.*, CASE WHEN extraction_mode <> 'discovery' THEN coalesce(document_type_key,
    CASE WHEN parser_type NOT IN ('csv', 'json') THEN template END) END AS key FROM d LEFT JOIN i ON d.doc_id = i.doc_id)
SELECT doc_id, key AS document_type_key, CASE WHEN key IS NOT NULL THEN {_NAMES}
    WHEN extraction_mode = 'template' THEN document_type_label END AS document_type_label,
  CASE WHEN key IS NOT NULL AND extraction_mode <> 'template' THEN 'auto_detect' ELSE extraction_mode END AS extraction_mode
FROM r""")
def resolve_mode(t: Tables):
    from workload.registry import INPUTS
    docs = t.sql(_MODES + "(" + INPUTS["all_texts"] + ") a")
    chosen = TP.resolve_template(docs, BUNDLED).withColumnRenamed("template_key", "applied_template")
    return TP.settle_mode(chosen, BUNDLED).select(
        "doc_id", "document_type_key", "document_type_label", "extraction_mode")


def matched(src: str) -> str:
    """Field rows with their template field, by a join on every candidate form of the name."""
    return f"""(SELECT f.*, m.fkey, m.forder, m.dtype, m.req, n.tname FROM {src} f
  LEFT JOIN (SELECT field_id, arg_min(fkey, forder) AS fkey, min(forder) AS forder, arg_min(dtype, forder) AS dtype,
      arg_min(req, forder) AS req FROM (SELECT field_id, doc_template, unnest({D.candidates('field_name')}) AS c FROM {src} f) c
      JOIN (SELECT *, unnest(synonyms) AS syn FROM {D.template_fields()} x) s ON s.template = c.doc_template AND s.syn = c.c
      GROUP BY field_id) m USING (field_id)
  LEFT JOIN (SELECT DISTINCT template, tname FROM {D.template_fields()} x) n ON n.template = f.doc_template)"""


_OFFICIAL = """CASE WHEN field_name LIKE 'records[%.%' THEN regexp_extract(field_name, '^(records\\[.*)\\.[^.]*$', 1) || '.' || fkey
  ELSE fkey END"""


def named_sql(src: str) -> str:
    return f"""(SELECT field_id, pos, doc_id, doc_template, tname, value, confidence, snippet, reasoning, fkey, forder,
  CASE WHEN fkey IS NOT NULL THEN {_OFFICIAL} WHEN tname IS NOT NULL THEN '{K.SUGGESTED}' ||
    coalesce(nullif({D.label_key('field_name')}, ''), 'unknown_field') ELSE field_name END AS field_name,
  CASE WHEN fkey IS NOT NULL THEN doc_template END AS template_key,
  CASE WHEN fkey IS NOT NULL THEN dtype WHEN tname IS NOT NULL THEN 'suggestion' END AS data_type,
  coalesce(req, false) AS required, CASE WHEN fkey IS NULL AND tname IS NOT NULL THEN true ELSE auto_accept END AS auto_accept
  FROM {matched(src)} m)"""


def best_sql(src: str) -> str:
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field_name ORDER BY confidence DESC, pos) AS rn
  FROM {named_sql(src)} n WHERE fkey IS NOT NULL) b WHERE rn = 1)"""


def missing_sql(src: str) -> str:
    return f"""(SELECT d.doc_id, d.doc_template, f.tname, f.fkey, f.forder, f.dtype FROM
  (SELECT DISTINCT doc_id, doc_template FROM {src} r) d JOIN {D.template_fields()} f ON f.template = d.doc_template AND f.req
  WHERE NOT EXISTS (SELECT 1 FROM {named_sql(src)} n WHERE n.doc_id = d.doc_id AND n.fkey = f.fkey))"""


_MATCHED, _NAMED, _BEST, _MISSING = (make("@raw_fields") for make in (matched, named_sql, best_sql, missing_sql))


@query("match_field", f"SELECT field_id, field_name, fkey AS field_key FROM {_MATCHED} m")
def match_field(t: Tables):
    return TP.match_fields(t.raw_fields, BUNDLED).select("field_id", "field_name", F.col("match.key").alias("field_key"))


def named(t: Tables):
    return TP.canonicalise(TP.match_fields(_with_rules(t), BUNDLED))


def _with_rules(t: Tables):
    from fieldmill.schemas import RULES, SOURCE
    fields = t.raw_fields
    for c, kind in (("standard_field_key", "string"), ("template_key", "string"), ("data_type", "string"),
                    ("rules", RULES), ("source", SOURCE)):
        fields = fields.withColumn(c, F.lit(None).cast(kind))
    return fields.withColumn("required", F.lit(False))


@query("canonicalise_fields", f"""
SELECT pos, field_name, fkey AS standard_field_key, template_key, data_type, required FROM {_NAMED} n WHERE fkey IS NOT NULL""")
def canonicalise_fields(t: Tables):
    return named(t).filter("standard_field_key is not null").select(
        "pos", "field_name", "standard_field_key", "template_key", "data_type", "required")


@query("collapse_duplicates", f"SELECT doc_id, field_name, pos, value, confidence FROM {_BEST} b")
def collapse_duplicates(t: Tables):
    return TP.collapse_duplicates(named(t).filter("standard_field_key is not null")).select(
        "doc_id", "field_name", "pos", "value", "confidence")


@query("missing_required", f"""
SELECT doc_id, fkey AS field_name, '' AS value, CAST(0 AS DOUBLE) AS confidence, dtype AS data_type, true AS required, false AS auto_accept,
  'Required field from template "' || tname || '" was missing and must be reviewed manually.' AS reasoning FROM {_MISSING} m""")
def missing_required(t: Tables):
    return TP.missing_required(named(t), BUNDLED).select(
        "doc_id", "field_name", "value", "confidence", "data_type", "required", "auto_accept", "reasoning")


@query("suggested_extras", f"""
SELECT pos, doc_id, field_name, data_type, auto_accept, value FROM {_NAMED} n WHERE fkey IS NULL AND tname IS NOT NULL""")
def suggested_extras(t: Tables):
    return named(t).filter("standard_field_key is null and template_name is not null").select(
        "pos", "doc_id", "field_name", "data_type", "auto_accept", "value")


_ORDERED = f"""
SELECT doc_id, 0 AS section, CASE WHEN field_name LIKE 'records[%' THEN 1 ELSE 0 END AS is_record,
  coalesce(try_cast(regexp_extract(field_name, '^records\\[([0-9]+)\\]', 1) AS BIGINT), 0) AS record,
  forder AS "order", 0 AS tie_break, field_name, value FROM {_BEST} b
UNION ALL SELECT doc_id, 0, 0, 0, forder, 0, fkey, '' FROM {_MISSING} m
UNION ALL SELECT doc_id, 1, 0, 0, 0, pos, field_name, value FROM {_NAMED} n WHERE fkey IS NULL"""


@query("template_order", f"SELECT * FROM ({_ORDERED}) o")
def template_order(t: Tables):
    rows = TP.order_columns(TP.apply_template(_with_rules(t), BUNDLED), BUNDLED)
    return rows.select(*TP.ORDER_BY, "value")


@query("display_order", f"""
SELECT doc_id, CASE WHEN tk IS NULL THEN 0 WHEN standard_field_key IS NOT NULL THEN 0
    WHEN field_name LIKE 'suggested\\_extra\\_fields.%' ESCAPE '\\' THEN 1
    WHEN contains(reasoning, 'Manually added by reviewer') THEN 2 ELSE 3 END AS category,
  CASE WHEN tk IS NULL THEN 0 ELSE coalesce(try_cast(regexp_extract(field_name, '^records\\[([0-9]+)\\]', 1) AS BIGINT), 0) END AS record,
  CASE WHEN tk IS NULL THEN 0 ELSE coalesce(x.forder, 9999) END AS "order", field_id, field_name
FROM @stored_fields s LEFT JOIN (SELECT DISTINCT template AS tk FROM {D.template_fields()} f) k ON k.tk = s.doc_template
LEFT JOIN {D.template_fields()} x ON x.template = s.doc_template
  AND x.fkey = coalesce(s.standard_field_key, list_last(string_split(s.field_name, '.')))""")
def display_order(t: Tables):
    return TP.display_order(t.stored_fields, BUNDLED).select(*TP.DISPLAY_BY)


@query("required_completeness", f"""
WITH n AS (SELECT * FROM {_NAMED} x WHERE fkey IS NOT NULL), need AS (SELECT template, count(*) AS c FROM {D.template_fields()} f WHERE req GROUP BY 1)
SELECT n.doc_id, n.doc_template, count(DISTINCT CASE WHEN required AND {D.blank('value')} = false THEN fkey END) AS found,
  any_value(c) AS required_count, count(DISTINCT CASE WHEN required AND {D.blank('value')} = false THEN fkey END) = any_value(c) AS complete
FROM n JOIN need ON need.template = n.doc_template GROUP BY n.doc_id, n.doc_template""")
def required_completeness(t: Tables):
    return TP.required_complete(named(t).filter("standard_field_key is not null"), BUNDLED)


_DECIDE = """SELECT doc_id, doc_id % 4 = 0 AS complete, doc_id % 4 < 2 AS has_labelled, doc_id % 3 < 2 AS eligible,
  doc_id % 5 = 0 AS cached, doc_id % 7 < 3 AS fresh, CASE WHEN doc_id % 11 = 0 THEN 'timeout ' || doc_id END AS error,
  CASE WHEN doc_id % 13 = 0 THEN 'quota of ' || doc_id END AS limited, doc_id % 17 <> 0 AND doc_id % 4 <> 2 AS fall_back, doc_id % 26 <> 0 AS defer,
  'p1' AS provider, 'm1' AS model, CASE WHEN doc_id % 2 = 0 THEN 'finance_invoice' END AS template_key FROM """
_STRATEGY = """CASE WHEN complete THEN 'deterministic_labelled' || sfx WHEN eligible AND cached THEN 'ai_cache:p1:m1' || sfx
  WHEN eligible AND limited IS NOT NULL THEN CASE WHEN NOT defer AND fall_back THEN 'deterministic_fallback_after_ai_rate_limit:p1' END
  WHEN eligible AND error IS NOT NULL THEN CASE WHEN fall_back THEN 'deterministic_fallback_after_ai_error:p1' END
  WHEN eligible AND (fresh OR has_labelled) THEN 'ai:p1:m1' || sfx WHEN eligible AND NOT fall_back THEN 'ai:p1:m1:empty'
  WHEN has_labelled THEN 'deterministic_labelled' || sfx ELSE 'deterministic' || sfx END"""


@query("extraction_strategy", f"""
WITH s AS (SELECT *, {_STRATEGY} AS strategy FROM (SELECT *, coalesce(':template:' || template_key, '') AS sfx
  FROM ({_DECIDE} @app_documents a) d) e),
f AS (SELECT doc_id, field_name, field_id % 6 AS j, value FROM @raw_fields r)
SELECT s.doc_id, strategy, field_name, value, NULL AS reasoning FROM s JOIN f ON f.doc_id = s.doc_id WHERE strategy IS NOT NULL AND (
  (j < 2 AND has_labelled) OR (j = 2 AND strategy LIKE 'ai%' AND (strategy NOT LIKE 'ai:%' OR fresh)) OR (j > 2 AND strategy NOT LIKE 'ai%' AND NOT complete))
UNION ALL SELECT doc_id, strategy, 'ai_fallback_reason', coalesce(limited, error), CASE WHEN limited IS NULL THEN {q(K.FALLBACK_ERROR_REASON)}
  ELSE {q(K.FALLBACK_LIMIT_REASON)} END FROM s WHERE strategy LIKE '%fallback%'
UNION ALL SELECT doc_id, strategy, CASE WHEN strategy IS NOT NULL THEN 'done' WHEN limited IS NOT NULL AND defer THEN 'deferred' ELSE 'failed' END, NULL, NULL FROM s""")
def extraction_strategy(t: Tables):
    from workload.registry import INPUTS
    d = t.sql(_DECIDE + "(" + INPUTS["app_documents"] + ") a")
    d = d.withColumn("strategy", TP.strategy(*[F.col(c) for c in (
        "complete", "has_labelled", "eligible", "cached", "fresh", "error", "provider", "model", "template_key", "limited", "fall_back", "defer")]))
    ends = d.select("doc_id", TP.outcome(*[F.col(c) for c in ("complete", "eligible", "cached", "error", "limited", "fall_back", "defer")]).alias("field_name"))
    rows = _with_rules(t).drop("doc_template").withColumn("j", F.col("field_id") % 6)
    labelled = rows.filter("j < 2").join(d.filter("has_labelled").select("doc_id"), "doc_id", "left_semi")
    given = d.filter("cached or fresh").select("doc_id")  # a model result without fields gives no rows
    chosen = TP.choose_fields(d, labelled, rows.filter("j = 2").join(given, "doc_id", "left_semi"), rows.filter("j > 2"))
    said = chosen.select("doc_id", "field_name", "value", F.when(F.col("field_name") == "ai_fallback_reason", F.col("reasoning")).alias("reasoning"))
    return said.unionByName(ends, allowMissingColumns=True).join(d.select("doc_id", "strategy"), "doc_id")


@query("field_definition_lookup", f"""
SELECT f.field_id, f.template_key, f.standard_field_key, d.definition_id FROM
  (SELECT field_id, CASE WHEN doc_id % 2 = 0 THEN 't' || (doc_id % 500) END AS template_key,
     CASE WHEN field_id % 3 = 0 THEN 'size' ELSE 'none' END AS standard_field_key FROM @raw_fields r) f
LEFT JOIN (SELECT template_key, field_key, template_order * 2 + "order" AS definition_id FROM ({_DEFINED}) x) d
  ON d.template_key = f.template_key AND d.field_key = f.standard_field_key""")
def field_definition_lookup(t: Tables):
    known = catalog.template_fields(definitions(t), "file").withColumn(
        "definition_id", F.col("template_order") * 2 + F.col("order"))
    fields = t.raw_fields.select(
        "field_id", F.when(F.col("doc_id") % 2 == 0, F.concat(
            F.lit("t"), (F.col("doc_id") % 500).cast("string"))).alias("template_key"),
        F.when(F.col("field_id") % 3 == 0, "size").otherwise("none").alias("standard_field_key"))
    return catalog.attach_definition(fields, known)


@query("template_contract_text", f"""
SELECT template_key, 'Template extraction mode: ' || max(name) || ' (' || template_key || ').' || chr(10) || {q(K.CONTRACT_HEAD)} || chr(10)
  || string_agg('- ' || field_key || ' (' || data_type || ', ' || CASE WHEN required THEN 'required' ELSE 'optional' END || '): ' || label
     || '.' || CASE WHEN len(aliases) > 0 THEN ' Aliases: ' || array_to_string(aliases, ', ') || '.' ELSE '' END, chr(10) ORDER BY "order")
  || chr(10) || {q(K.CONTRACT_TAIL)} AS contract FROM ({_DEFINED}) d GROUP BY template_key""")
def template_contract_text(t: Tables):
    return catalog.contract_text(catalog.template_fields(definitions(t), "file"))
