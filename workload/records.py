"""Records and JSON as field rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmill import constants as K
from fieldmill.operators import ingest as I, records as R
from workload import duck as D
from workload.ingest import NUMBERED, order_records
from workload.registry import Tables, q, query

_CELLS = f"""(SELECT doc_id, record, unnest([0, 1, 2, 3]) AS column_pos, unnest(['order_key', 'day', 'priority', 'price']) AS col,
  coalesce(unnest([CAST(order_key AS VARCHAR), day, priority, price]), '') AS value FROM {NUMBERED} r)"""


@query("records_to_fields", f"""
SELECT doc_id, record, column_pos, name AS field_name, value, CAST(CASE WHEN b THEN 0.75 ELSE 1.0 END AS DOUBLE) AS confidence,
  left(name || ': ' || value, 500) AS snippet, NOT b AS auto_accept, record + 1 AS source_row, col AS source_column,
  CASE WHEN b THEN {q(K.CSV_BLANK_REASON)} ELSE {q(K.CSV_CELL_REASON)} END AS reasoning
FROM (SELECT *, 'records[' || record || '].' || col AS name, {D.blank('value')} AS b FROM {_CELLS} c) n""")
def records_to_fields(t: Tables):
    return R.records_to_fields(order_records(t)).select(
        "doc_id", "record", "column_pos", "field_name", "value", "confidence", "snippet", "auto_accept",
        F.col("source.row").alias("source_row"), F.col("source.column").alias("source_column"), "reasoning")


@query("dataset_summary_fields", """
WITH n AS (SELECT doc_id, count(*) AS n FROM @order_rows o GROUP BY doc_id)
SELECT doc_id, 0 AS pos, 'document_type' AS field_name, 'structured_csv' AS value, CAST(1 AS DOUBLE) AS confidence FROM n
UNION ALL SELECT doc_id, 1, 'summary', n || ' CSV record(s) with columns: order_key, day, priority, price.', 1 FROM n
UNION ALL SELECT doc_id, 2, 'record_count', CAST(n AS VARCHAR), 1 FROM n
UNION ALL SELECT doc_id, 3, 'schema_fields', 'order_key, day, priority, price', 1 FROM n
UNION ALL SELECT doc_id, 4, 'primary_entity', 'structured_records', 0.95 FROM n""")
def dataset_summary_fields(t: Tables):
    return R.dataset_summary(order_records(t)).select("doc_id", "pos", "field_name", "value", "confidence")


@query("schema_key_union", """
WITH k AS (SELECT doc_id, i, json_keys(item) AS ks FROM (SELECT doc_id, CAST(e.key AS INT) AS i, e.value AS item
    FROM @json_docs d, json_each(d.text) e WHERE d.doc_id % 6 = 1) x WHERE json_type(item) = 'OBJECT'),
f AS (SELECT doc_id, key, min(i * 1000 + p) AS place FROM (SELECT doc_id, i, unnest(ks) AS key,
    generate_subscripts(ks, 1) AS p FROM k) u GROUP BY doc_id, key)
SELECT doc_id, string_agg(key, ', ' ORDER BY place) AS schema_keys FROM f GROUP BY doc_id""")
def schema_key_union(t: Tables):
    described = R.json_fields(t.json_docs, leaves=False).where("shape = 'array' and is_head and field_name = 'schema_fields'")
    return described.select("doc_id", F.col("value").alias("schema_keys"))


def _tree(where: str) -> str:
    """Leaves of valid JSON documents by DuckDB's own tree walk."""
    return f"""(SELECT d.doc_id, t.type, CASE WHEN t.type = 'NULL' THEN 'null' ELSE json_extract_string(t.value, '$') END AS leaf,
      regexp_replace(substr(t.fullkey, 2), '^\\.', '') AS raw, t.id AS place
      FROM (SELECT * FROM @json_docs j WHERE json_valid(text) AND {where}) d, json_tree(d.text) t
      WHERE t.type NOT IN ('OBJECT', 'ARRAY'))"""


_PATH = """CASE WHEN raw = '' THEN 'value' WHEN raw LIKE '[%' THEN 'records' || raw ELSE raw END"""


@query("json_flatten", f"SELECT doc_id, {_PATH} AS path, leaf, false AS too_deep FROM {_tree('true')} x")
def json_flatten(t: Tables):
    return R.flatten(t.json_docs).select("doc_id", "path", "leaf", "too_deep")


@query("json_array_to_fields", f"""
SELECT doc_id, path AS field_name, value, left(path || ': ' || value, 500) AS snippet, path AS json_path FROM (
  SELECT doc_id, CASE WHEN raw LIKE '[2]' THEN 'records[2]'
    WHEN raw = '[1].w.w' THEN 'records[1].w' ELSE 'records' || replace(raw, '.tags[', '.tags.records[') END AS path,
    CASE WHEN raw = '[2]' THEN '"' || leaf || '"' ELSE leaf END AS value FROM {_tree("json_type(text) = 'ARRAY'")} x) f""")
def json_array_to_fields(t: Tables):
    return R.json_array_fields(t.json_docs).select("doc_id", "field_name", "value", "snippet",
                                              F.col("source.json_path").alias("json_path"))


@query("json_object_to_fields", f"""
WITH o AS (SELECT doc_id, array_to_string(json_keys(text), ', ') AS keys FROM @json_docs j
           WHERE json_valid(text) AND json_type(text) = 'OBJECT')
SELECT doc_id, 2 + row_number() OVER (PARTITION BY doc_id ORDER BY place) AS pos, {_PATH} AS field_name, leaf AS value,
  CAST(1 AS DOUBLE) AS confidence, left({_PATH} || ': ' || leaf, 500) AS snippet FROM {_tree("json_type(text) = 'OBJECT'")} x
UNION ALL SELECT doc_id, 0, 'document_type', 'structured_json_object', 1, NULL FROM o
UNION ALL SELECT doc_id, 1, 'summary', 'JSON object with fields: ' || keys || '.', 1, keys FROM o
UNION ALL SELECT doc_id, 2, 'schema_fields', keys, 1, keys FROM o""")
def json_object_to_fields(t: Tables):
    return R.json_object_fields(t.json_docs).select("doc_id", "pos", "field_name", "value", "confidence", F.when(
        F.col("field_name") != "document_type", F.col("snippet")).alias("snippet"))


@query("json_scalar_to_fields", """
WITH s AS (SELECT doc_id, text, json_type(text) AS kind FROM @json_docs j WHERE json_valid(text)
           AND json_type(text) NOT IN ('OBJECT', 'ARRAY'))
SELECT doc_id, 'document_type' AS field_name, 'structured_json_' || CASE kind WHEN 'VARCHAR' THEN 'str' ELSE 'int' END AS value
FROM s UNION ALL SELECT doc_id, 'value', text FROM s""")
def json_scalar_to_fields(t: Tables):
    return R.json_scalar_fields(t.json_docs).select("doc_id", "field_name", "value")


@query("embedded_json", """
SELECT doc_id, CASE WHEN kind IN ('OBJECT', 'ARRAY') THEN kind END AS kind,
  CASE WHEN kind = 'ARRAY' THEN 4 END AS csv_records, CASE WHEN kind = 'ARRAY' THEN json_extract_string(good, '$[2]') END AS wrapped
FROM (SELECT doc_id, good, json_type(good) AS kind FROM (
  SELECT doc_id, CASE WHEN json_valid(text) THEN text END AS good FROM @json_docs j) g) k""")
def embedded_json(t: Tables):
    d = t.json_docs.withColumn("noted", F.concat(F.lit("JSON document below\n"), F.col("text"))).withColumn(
        "marked", F.concat(F.lit(f"2 rows\n{K.CSV_MARKER}\n"), F.col("text")))
    kind = F.upper(I.json_shape(R.embedded_json(F.col("noted"))))
    records = F.when(kind == "ARRAY", R.embedded_csv_records(F.col("marked")))
    return d.select("doc_id", kind.alias("kind"), F.when(records.isNotNull(), F.size(records)).alias("csv_records"),
                    F.try_element_at(records, F.lit(3))["value"].alias("wrapped"))
