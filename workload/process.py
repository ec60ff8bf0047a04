"""Whole runs: documents in, decided fields out."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmill import constants as K
from fieldmill.catalogue import Catalogue
from fieldmill.operators import templates as TP
from fieldmill.plans import process as P
from workload import duck as D
from workload.extraction import _generic
from workload.records import _PATH, _tree
from workload.registry import Tables, q, query
from workload.templates import best_sql, missing_sql, named_sql
from workload.validation import _check

BUNDLED = Catalogue.bundled()


#: The CTEs checked and final over `named`: validation with the rules of the bundled templates, and the decision.
DECIDED = f"""checked AS (SELECT *, {_check('status')} AS validation_status, {_check('rule')} AS validation_rule FROM (
  SELECT *, CASE WHEN data_type = 'currency' THEN CAST(0 AS DOUBLE) END AS lo, CASE WHEN standard_field_key = 'account_number' AND value <> '' THEN 6
      WHEN data_type = 'string' AND standard_field_key IS NOT NULL AND value <> '' THEN 1 END AS minlen,
    CASE WHEN standard_field_key = 'account_number' AND value <> '' THEN '^[0-9 -]{{6,20}}$' END AS pat, false AS cur, false AS allowed, false AS must FROM named)),
final AS (SELECT *, validation_status IN ('invalid', 'missing_required') OR confidence < 0.8 OR NOT auto AS needs_review FROM checked)"""


def run_sql(texts: str) -> str:
    """CTEs of the whole run over (doc_id, text, parser_type), step by step, ending in `final`."""
    return f"""
WITH docs AS MATERIALIZED (SELECT *, lower(text) AS low FROM {texts} a),
pick AS MATERIALIZED (SELECT doc_id, template FROM {D.inferred('docs')} i),
lab AS MATERIALIZED (SELECT * FROM {D.labelled("(SELECT d.doc_id, d.text, p.template FROM docs d JOIN pick p ON p.doc_id = d.doc_id)")} l),
full_ AS (SELECT l.doc_id FROM lab l JOIN (SELECT template, count(*) AS c FROM {D.template_fields()} f WHERE req GROUP BY template) n
  ON n.template = l.template WHERE req GROUP BY l.doc_id, c HAVING count(*) = c),
rows_ AS MATERIALIZED (SELECT doc_id, forder AS pos, fkey AS field_name, value, CAST(0.98 AS DOUBLE) AS confidence, true AS auto FROM lab
  UNION ALL SELECT doc_id, 100 + p, field_name, value, confidence, false FROM {_generic('docs')} g WHERE doc_id NOT IN (SELECT doc_id FROM full_)),
syn AS (SELECT *, unnest(synonyms) AS s FROM {D.template_fields()} x),
cand AS (SELECT r.doc_id, r.pos, p.template, unnest({D.candidates('r.field_name')}) AS c FROM rows_ r JOIN pick p ON p.doc_id = r.doc_id),
hit AS (SELECT doc_id, pos, min(forder) AS ord FROM cand JOIN syn ON syn.template = cand.template AND syn.s = cand.c GROUP BY doc_id, pos),
tagged AS MATERIALIZED (SELECT r.*, p.template, hit.ord FROM rows_ r LEFT JOIN pick p ON p.doc_id = r.doc_id
  LEFT JOIN hit ON hit.doc_id = r.doc_id AND hit.pos = r.pos),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY confidence DESC, pos) AS rn FROM tagged WHERE ord IS NOT NULL) WHERE rn = 1),
named AS (
  SELECT b.doc_id, f.fkey AS field_name, b.value, b.confidence, b.auto, f.fkey AS standard_field_key, f.dtype AS data_type, f.req AS required
    FROM best b JOIN {D.template_fields()} f ON f.template = b.template AND f.forder = b.ord
  UNION ALL SELECT p.doc_id, f.fkey, '', 0, false, f.fkey, f.dtype, true FROM pick p JOIN {D.template_fields()} f ON f.template = p.template AND f.req
    WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.doc_id = p.doc_id AND b.ord = f.forder)
  UNION ALL SELECT doc_id, CASE WHEN template IS NULL THEN field_name ELSE 'suggested_extra_fields.' || {D.label_key('field_name')} END, value, confidence,
    auto OR template IS NOT NULL, NULL, CASE WHEN template IS NOT NULL THEN 'suggestion' END, false FROM tagged WHERE ord IS NULL),
{DECIDED}
"""


def _docs(t: Tables):
    return t.all_texts.select(
        "doc_id", F.col("text").alias("raw_text"), "parser_type", F.lit("auto_detect").alias("extraction_mode"),
        F.lit(None).cast("string").alias("document_type_key"))


SHOWN = ["doc_id", "field_name", "value", "confidence", "standard_field_key", "data_type", "validation_status",
         "validation_rule", "needs_review", "accepted"]
SHOWN_SQL = ("SELECT doc_id, field_name, value, confidence, standard_field_key, data_type, validation_status, validation_rule, "
             "needs_review, auto AND NOT needs_review AS accepted FROM final")


@query("process_documents", run_sql("@all_texts") + SHOWN_SQL)
def process_documents(t: Tables):
    return P.field_rows(P.process_text(_docs(t), BUNDLED)).select(*SHOWN)


_DOC_SQL = run_sql("@all_texts") + """, per_doc AS (SELECT d.doc_id,
    CASE WHEN d.doc_id IN (SELECT doc_id FROM lab) THEN 'deterministic_labelled' ELSE 'deterministic' END || coalesce(':template:' || p.template, '') AS strategy,
    CASE WHEN bool_or(f.needs_review) THEN 'needs_review' ELSE 'approved' END AS status, count(*) FILTER (WHERE f.auto AND NOT f.needs_review) AS a,
    count(*) FILTER (WHERE NOT (f.auto AND NOT f.needs_review)) AS b
  FROM docs d JOIN final f ON f.doc_id = d.doc_id LEFT JOIN pick p ON p.doc_id = d.doc_id GROUP BY d.doc_id, p.template)"""


@query("processed_status", _DOC_SQL + """
SELECT strategy, status, count(*) AS documents, sum(a)::BIGINT AS accepted_fields, sum(b)::BIGINT AS review_fields FROM per_doc GROUP BY strategy, status""")
def processed_status(t: Tables):
    return P.process_text(_docs(t), BUNDLED).groupBy("strategy", "status").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("accepted_fields").alias("accepted_fields"),
        F.sum("review_fields").alias("review_fields"))


# --- structured documents ----------------------------------------------------------------------

# JSON arrays whose records name one field twice, some with a template.
_ALIASED = """SELECT o_orderkey + 2000000000 AS doc_id, o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'finance_invoice' WHEN 1 THEN 'own_kind' END AS doc_template,
  '[' || chr(123) || '"supplier":"A' || o_orderkey || '","vendor":"B' || o_orderkey || '","total":"RM 1' || o_orderkey || '.50"' || chr(125)
  || CASE WHEN o_orderkey % 2 = 0 THEN ',' || chr(123) || '"Invoice No":"I-' || o_orderkey || '","Total":"none","note":""' || chr(125) ELSE '' END || ']' AS text FROM """


def _structured_inputs(t: Tables):
    def documents(rows, parser, template, shift=0):
        return rows.select((F.col("doc_id") + shift).alias("doc_id"), "text", F.lit(parser).alias("parser_type"),
                           template.cast("string").alias("document_type_key"))
    return documents(t.json_docs, "json", F.lit(None)).unionByName(documents(t.csv_docs, "csv", F.lit(None), 1000000000)).unionByName(
        documents(t.sql(_ALIASED + "{orders}"), "json", F.col("doc_template")))


def _pretty(*parts: str) -> str:
    """SQL for a pretty-printed text. A part is literal text, with line ends, or an expression behind an equals sign."""
    return " || ".join(p[1:] if p.startswith("=") else " || chr(10) || ".join(q(line) for line in p.split("\n")) for p in parts)


_PRICE = "=CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS VARCHAR)"
_OBJECT_SHOWN = _pretty(
    'JSON document containing an object with keys: customer, day, lines, note, open, z.\n{\n  "customer": ', "=o_custkey", ',\n  "day": "',
    "=CAST(CAST(o_orderdate AS DATE) AS VARCHAR)", '",\n  "lines": [\n    {\n      "no": 1,\n      "price": ', _PRICE,
    '\n    },\n    {\n      "no": 2,\n      "tags": [\n        "a",\n        null\n      ]\n    }\n  ],\n  "note": null,\n  "open": true')
_ARRAY_SHOWN = _pretty(
    'JSON document containing a list with 4 items.\n[\n  {\n    "id": ', "=o_orderkey", ',\n    "priority": "', "=o_orderpriority",
    '"\n  },\n  {\n    "price": ', _PRICE, ',\n    "tags": [\n      "x",\n      ', "=o_custkey", '\n    ],\n    "w": {\n      "w": ', "=o_custkey",
    '\n    }\n  },\n  "loose",\n  {\n    "id": null\n  }\n]')
_ALIASED_SHOWN = _pretty(
    "JSON document containing a list with ", "=n", ' items.\n[\n  {\n    "supplier": "A', "=k", '",\n    "vendor": "B', "=k", '",\n    "total": "RM 1', "=k", '.50"\n  }',
    "=CASE WHEN n = 2 THEN " + _pretty(',\n  {\n    "Invoice No": "I-', "=k", '",\n    "Total": "none",\n    "note": ""\n  }') + " ELSE '' END", "\n]")
# The readable texts of the documents of @json_docs and @csv_docs, of which the describing rows show the beginning.
_JSON_TEXT = f"""(SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN {_OBJECT_SHOWN} WHEN 1 THEN {_ARRAY_SHOWN}
  WHEN 2 THEN 'JSON document containing str.' || chr(10) || '"' || o_orderpriority || '"' WHEN 3 THEN 'JSON document containing int.' || chr(10) || o_custkey END AS shown FROM orders)"""
_CSV_TEXT = """(SELECT doc_id, rows_, keys_, 'CSV document with ' || rows_ || ' rows and 3 columns.' || chr(10) || 'Columns: key, note, price' || chr(10)
    || 'Preview row 1: key: ' || (doc_id - 1000000000) || '; note: say "hi"' || sep || ' ' || customer || '; price: ' || price
    || CASE WHEN short THEN chr(10) || 'Preview row 2: key: short; note: None; price: None' ELSE '' END
    || CASE WHEN surplus THEN chr(10) || 'Preview row ' || rows_ || ': key: a; note: ; price: c; null: [''d'', ''e'']' ELSE '' END AS shown
  FROM (SELECT doc_id + 1000000000 AS doc_id, customer, price, sep, doc_id % 5 = 0 AS short, doc_id % 7 = 0 AS surplus,
    1 + CAST(doc_id % 5 = 0 AS INT) + CAST(doc_id % 7 = 0 AS INT) AS rows_, 'key, note, price' || CASE WHEN doc_id % 7 = 0 THEN ', null' ELSE '' END AS keys_ FROM @csv_docs c) r)"""


def _heads(kind: str, doc: str, n: str, keys: str) -> str:
    """The describing rows of the record sets of `doc` (doc_id, shown): doc_id, pos, field_name, value, confidence, snippet, reasoning."""
    why, csv = K.DATASET_REASONS[kind], kind == "csv"
    summary = f"{n} || ' {'CSV' if csv else 'JSON'} record(s) with {'columns' if csv else 'fields'}: ' || {keys} || '.'"
    counted = f"'{'CSV row count' if csv else 'Array length'}: ' || {n}"
    rows = [("document_type", q("structured_csv" if csv else "structured_json_array"), "1", "left(shown, 220)"), ("summary", summary, "1", summary),
            ("record_count", f"CAST({n} AS VARCHAR)", "1", counted), ("schema_fields", keys, "1", keys),
            ("primary_entity", "'structured_records'", "0.95", "left(shown, 160)")]
    return " UNION ALL ".join(
        f"SELECT doc_id, {i} AS pos, '{name}' AS field_name, {value} AS value, CAST({c} AS DOUBLE) AS confidence, {snip} AS snippet, {q(why[i])} AS reasoning FROM {doc}"
        for i, (name, value, c, snip) in enumerate(rows))


def _cells(first: str, record: str, names: str, cells: str, where: str) -> str:
    """The rows of one CSV record of the documents of @csv_docs; first: position of its first cell."""
    blank = D.blank("cell")
    return f"""SELECT doc_id, pos, name, coalesce(cell, ''), CASE WHEN {blank} THEN 0.75 ELSE 1.0 END, left(name || ': ' || coalesce(cell, ''), 500),
    CASE WHEN {blank} THEN {q(K.CSV_BLANK_REASON)} ELSE {q(K.CSV_CELL_REASON)} END FROM (
      SELECT doc_id + 1000000000 AS doc_id, {first} + generate_subscripts({names}, 1) - 1 AS pos, 'records[' || {record} || '].' || unnest({names}) AS name, unnest({cells}) AS cell
      FROM @csv_docs c WHERE {where}) c"""


_LEAF = q(K.JSON_LEAF_REASON)
_NAMES = "['key', 'note', 'price']"
_STRUCTURED = f"""
WITH al AS MATERIALIZED (SELECT *, {_ALIASED_SHOWN} AS shown FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS n,
    CASE WHEN k % 2 = 0 THEN 'supplier, vendor, total, Invoice No, Total, note' ELSE 'supplier, vendor, total' END AS keys FROM ({_ALIASED} orders) a) b),
cs AS MATERIALIZED (SELECT * FROM {_CSV_TEXT} c), js AS MATERIALIZED (SELECT * FROM {_JSON_TEXT} j WHERE shown IS NOT NULL),
ar AS (SELECT doc_id, shown, 4 AS n, 'id, priority, price, tags, w' AS keys FROM js WHERE doc_id % 6 = 1),
raw_rows AS (
  {_heads('json', 'al', 'n', 'keys')}
  UNION ALL SELECT doc_id, pos, name, value, 1.0, name || ': ' || value, {_LEAF} FROM (
    SELECT doc_id, unnest([5, 6, 7]) AS pos, 'records[0].' || unnest(['supplier', 'vendor', 'total']) AS name, unnest(['A' || k, 'B' || k, 'RM 1' || k || '.50']) AS value FROM al
    UNION ALL SELECT doc_id, unnest([8, 9, 10]), 'records[1].' || unnest(['Invoice No', 'Total', 'note']), unnest(['I-' || k, 'none', '']) FROM al WHERE n = 2) v
  UNION ALL {_heads('json', 'ar', 'n', 'keys')}
  UNION ALL SELECT doc_id, 4 + row_number() OVER (PARTITION BY doc_id ORDER BY place), path, value, 1.0, left(path || ': ' || value, 500),
    CASE WHEN path = 'records[2]' THEN {q(K.JSON_ITEM_REASON)} ELSE {_LEAF} END FROM (SELECT doc_id, place,
    CASE WHEN raw LIKE '[2]' THEN 'records[2]' WHEN raw = '[1].w.w' THEN 'records[1].w' ELSE 'records' || replace(raw, '.tags[', '.tags.records[') END AS path,
    CASE WHEN raw = '[2]' THEN '"' || leaf || '"' ELSE leaf END AS value FROM {_tree("json_type(text) = 'ARRAY'")} x) f
  UNION ALL SELECT doc_id, unnest([0, 1, 2]), unnest(['document_type', 'summary', 'schema_fields']), unnest(['structured_json_object',
    'JSON object with fields: customer, day, lines, note, open, z.', 'customer, day, lines, note, open, z']), 1.0,
    unnest([left(shown, 220), 'customer, day, lines, note, open, z', 'customer, day, lines, note, open, z']), unnest([{', '.join(q(x) for x in K.OBJECT_REASONS[:3])}])
    FROM js WHERE doc_id % 6 = 0
  UNION ALL SELECT doc_id, 2 + row_number() OVER (PARTITION BY doc_id ORDER BY place), {_PATH}, leaf, 1.0, left({_PATH} || ': ' || leaf, 500), {_LEAF}
    FROM {_tree("json_type(text) = 'OBJECT'")} x
  UNION ALL SELECT j.doc_id, unnest([0, 1]), unnest(['document_type', 'value']), unnest(['structured_json_' || CASE j.doc_id % 6 WHEN 2 THEN 'str' ELSE 'int' END, j.text]), 1.0,
    left(shown, 220), unnest([{q(K.OBJECT_REASONS[3])}, {q(K.JSON_SCALAR_REASON)}]) FROM js JOIN @json_docs j ON j.doc_id = js.doc_id WHERE j.doc_id % 6 IN (2, 3)
  UNION ALL {_heads('csv', 'cs', 'rows_', 'keys_')}
  UNION ALL {_cells("5", "0", _NAMES, "[CAST(doc_id AS VARCHAR), 'say " + chr(34) + "hi" + chr(34) + "' || sep || ' ' || customer, price]", "true")}
  UNION ALL {_cells("8", "1", _NAMES, "['short', NULL, NULL]", "doc_id % 5 = 0")}
  UNION ALL {_cells("CASE WHEN doc_id % 5 = 0 THEN 11 ELSE 8 END", "CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END", "['key', 'note', 'price', 'null']",
                    "['a', '', 'c', '[''d'', ''e'']']", "doc_id % 7 = 0")}),
src AS MATERIALIZED (SELECT r.*, row_number() OVER () AS field_id, confidence >= 0.95 AS auto_accept, CASE WHEN t.doc_template = 'finance_invoice' THEN t.doc_template END AS doc_template
  FROM raw_rows r LEFT JOIN al t ON t.doc_id = r.doc_id),
named AS (
  SELECT doc_id, doc_template, field_name, value, confidence, auto_accept AS auto, fkey AS standard_field_key, template_key, data_type, required, snippet, reasoning, forder, pos FROM {best_sql('src')} b
  UNION ALL SELECT doc_id, doc_template, fkey, '', 0, false, fkey, doc_template, dtype, true, {q(K.MISSING_SNIPPET)},
    'Required field from template "' || tname || '" was missing and must be reviewed manually.', forder, 0 FROM {missing_sql('(SELECT * FROM src WHERE doc_template IS NOT NULL)')} m
  UNION ALL SELECT doc_id, doc_template, field_name, value, confidence, auto_accept, NULL, NULL, data_type, false, snippet, reasoning, NULL, pos FROM {named_sql('src')} n WHERE fkey IS NULL),
{DECIDED}"""


@query("process_structured", f"""{_STRUCTURED}
SELECT doc_id, field_name, value, confidence, snippet, reasoning, standard_field_key, template_key, data_type, required, validation_status, validation_rule, needs_review,
  auto AND NOT needs_review AS accepted, CASE WHEN standard_field_key IS NULL THEN 1 ELSE 0 END AS section,
  CASE WHEN standard_field_key IS NOT NULL AND field_name LIKE 'records[%' THEN 1 ELSE 0 END AS is_record,
  CASE WHEN standard_field_key IS NOT NULL THEN coalesce(try_cast(regexp_extract(field_name, '^records\\[([0-9]+)\\]', 1) AS BIGINT), 0) ELSE 0 END AS record,
  coalesce(forder, 0) AS "order", CASE WHEN standard_field_key IS NULL THEN pos ELSE 0 END AS tie_break FROM final""")
def process_structured(t: Tables):
    return P.process_structured(_structured_inputs(t), BUNDLED).select(
        *TP.ORDER_BY, "value", "confidence", "snippet", "reasoning", "standard_field_key", "template_key", "data_type", "required",
        "validation_status", "validation_rule", "needs_review", "accepted")


@query("structured_documents", f"""{_STRUCTURED}
SELECT doc_id, 'deterministic' || coalesce(':template:' || max(doc_template), '') AS strategy, max(doc_template) AS applied_template,
  CASE WHEN max(doc_template) IS NOT NULL THEN {q(next(x.name for x in BUNDLED.templates if x.key == 'finance_invoice'))} END AS document_type_label,
  CASE WHEN bool_or(needs_review) THEN 'needs_review' ELSE 'approved' END AS status, count(*) FILTER (WHERE auto AND NOT needs_review) AS accepted_fields,
  count(*) FILTER (WHERE NOT (auto AND NOT needs_review)) AS review_fields, NULL AS reject_reason FROM final GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, 'Invalid JSON' FROM @json_docs j WHERE NOT json_valid(text)""")
def structured_documents(t: Tables):
    return P.structured_documents(P.structured_fields(_structured_inputs(t), BUNDLED), BUNDLED)
