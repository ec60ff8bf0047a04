"""Sources, parsing, document building and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmill import constants as K
from fieldmill.operators import catalog, ingest as I
from fieldmill.operators.skew import row_index
from fieldmill.schemas import TEMPLATE_FILE
from fieldmill.sources import versions as V
from fieldmill.sources.csv_ranges import read_csv_records
from fieldmill.sources.files import replace_by_document as replace_documents
from workload import duck as D
from workload.registry import Tables, new_folder, q, query

_UPLOADS = """
SELECT doc_id, source || CASE doc_id % 8 WHEN 0 THEN '.TXT' WHEN 1 THEN '.md' WHEN 2 THEN '.csv' WHEN 3 THEN '.json'
    WHEN 4 THEN '.pdf' WHEN 5 THEN '.docx' WHEN 6 THEN '' ELSE '.v1.bin' END AS filename,
  CASE doc_id % 5 WHEN 0 THEN 'Text/Markdown; charset=utf-8' WHEN 1 THEN 'application/csv' WHEN 2 THEN 'application/json'
    WHEN 3 THEN 'image/png' END AS content_type FROM """


@query("route_format", f"""
SELECT doc_id, format, CASE WHEN format IS NULL THEN {q(K.UNSUPPORTED_REASON)} END AS reject_reason FROM (
  SELECT doc_id, CASE WHEN sfx IN ('.txt', '.md') OR mime IN ('text/plain', 'text/markdown') THEN 'text'
    WHEN sfx = '.csv' OR mime IN ('text/csv', 'application/csv') THEN 'csv'
    WHEN sfx = '.json' OR mime = 'application/json' THEN 'json'
    WHEN sfx = '.pdf' OR mime = 'application/pdf' THEN 'pdf' END AS format
  FROM (SELECT doc_id, lower(regexp_extract(filename, '\\.[^.]*$')) AS sfx,
          lower(split_part(content_type, ';', 1)) AS mime FROM ({_UPLOADS} documents) u) s) r""")
def route_format(t: Tables):
    return I.route_format(t.sql(_UPLOADS + "{documents}")).select("doc_id", "format", "reject_reason")


@query("text_source", """
SELECT doc_id, raw_text, left(raw_text, 500) AS preview, 'plain_text' AS parser_type FROM (
  SELECT doc_id, text || CASE WHEN doc_id % 4 = 0 THEN chr(65533) ELSE '' END AS raw_text FROM documents) d""")
def text_source(t: Tables):
    bad = F.when(F.col("doc_id") % 4 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    uploads = t.documents.select("doc_id", F.concat(F.encode("text", "UTF-8"), bad).alias("content"))
    return I.parse_text(uploads).select("doc_id", "raw_text", "preview", "parser_type")


@query("inline_text", """
SELECT doc_id, 'raw-text.txt' AS filename, 'raw_text' AS parser_type, left(text, 500) AS preview FROM documents""")
def inline_text(t: Tables):
    return I.parse_inline(t.documents).select("doc_id", "filename", "parser_type", "preview")


_CSV_ROWS = """
SELECT doc_id, 0 AS record, 'key' AS name, CAST(doc_id AS VARCHAR) AS value FROM d
UNION ALL SELECT doc_id, 0, 'note', 'say "hi"' || sep || ' ' || customer FROM d
UNION ALL SELECT doc_id, 0, 'price', price FROM d
UNION ALL SELECT doc_id, 1, unnest(['key', 'note', 'price']), unnest(['short', NULL, NULL]) FROM d WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END, unnest(['key', 'note', 'price', 'null']),
  unnest(['a', '', 'c', '[''d'', ''e'']']) FROM d WHERE doc_id % 7 = 0"""


@query("csv_source", f"WITH d AS (SELECT * FROM @csv_docs c) {_CSV_ROWS}")
def csv_source(t: Tables):
    records = I.csv_records(I.parse_csv(t.csv_docs))
    return records.select("doc_id", "record", F.inline("cells"))


# Orders with a note that holds separators, quotes and line ends, as a CSV table.
_NOTED = """SELECT o_orderkey AS order_key, o_custkey AS customer, CASE WHEN o_orderkey % 3 = 0 THEN 'plain ' || o_orderstatus
    WHEN o_orderkey % 3 = 1 THEN 'say "hi",' || chr(10) || o_orderpriority || chr(10) || chr(10) || '"end' ELSE 'a "b" ' || chr(13) || chr(10) || 'c' END AS note,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS price FROM """


@query("csv_ranges", f"""
SELECT order_key, customer, note, price, 4 AS cells, true AS in_place FROM (SELECT CAST(order_key AS VARCHAR) AS order_key,
  CAST(customer AS VARCHAR) AS customer, note, price FROM ({_NOTED} orders) n) s""")
def csv_ranges(t: Tables):
    folder = new_folder(t)
    t.sql(_NOTED + "{orders}").write.csv(folder, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    files, records = read_csv_records(t.spark, f"{folder}/*.csv", range_bytes=1 << 16)
    # the numbers of a file's records are 0, 1, 2, ...: their sum is known from their count
    placed = records.groupBy("doc_id").agg((F.sum("record") * 2 == F.count(F.lit(1)) * (F.count(F.lit(1)) - 1)).alias("in_place"))
    cells = F.map_from_entries("cells")
    return records.join(placed, "doc_id").select(
        *[F.get(F.col("cells"), F.lit(i))["value"].alias(c) for i, c in enumerate(("order_key", "customer", "note", "price"))],
        F.size(cells).alias("cells"), "in_place")


def order_records(t: Tables):
    """Orders as records of their customer, numbered in key order."""
    rows = row_index(t.order_rows, ["doc_id"], F.floor(F.col("order_key") / 100_000), ["order_key"], "record")
    names = ["order_key", "day", "priority", "price"]
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in names])
    return rows.select("doc_id", "record", cells.alias("cells"))


NUMBERED = """(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY order_key) - 1 AS record FROM @order_rows o)"""


@query("csv_profile_text", f"""
SELECT doc_id, count(*) AS n_rows, 'CSV document with ' || count(*) || ' rows and 4 columns.' || chr(10)
  || 'Columns: order_key, day, priority, price' || chr(10)
  || string_agg('Preview row ' || (record + 1) || ': order_key: ' || order_key || '; day: ' || day || '; priority: '
       || coalesce(priority, 'None') || '; price: ' || price, chr(10) ORDER BY record) FILTER (WHERE record < 10)
  || CASE WHEN count(*) > 10 THEN chr(10) || '... ' || (count(*) - 10) || ' additional rows omitted from preview.'
     ELSE '' END AS profile_text
FROM {NUMBERED} r GROUP BY doc_id""")
def csv_profile_text(t: Tables):
    return I.csv_profile(order_records(t))


# Objects that name a member twice: the last value counts, at the first place.
_REPEATED = """SELECT o_orderkey + 2000000000 AS doc_id, o_custkey AS customer, chr(123) || '"a":[1],"b":' || o_custkey || ',"a":"last"' || chr(125) AS text FROM """


@query("json_source", f"""
SELECT doc_id, shape, reason AS reject_reason, CASE shape
    WHEN 'object' THEN 'JSON document containing an object with keys: customer, day, lines, note, open, z.'
    WHEN 'array' THEN 'JSON document containing a list with 4 items.'
    ELSE 'JSON document containing ' || shape || '.' END AS first_line, NULL AS whole
FROM (SELECT doc_id, CASE WHEN NOT json_valid(text) THEN NULL ELSE CASE json_type(text) WHEN 'OBJECT' THEN 'object'
    WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'str' ELSE 'int' END END AS shape,
    CASE WHEN NOT json_valid(text) THEN 'Invalid JSON' END AS reason FROM @json_docs j) s
UNION ALL SELECT doc_id, 'object', NULL, 'JSON document containing an object with keys: a, b.',
  'JSON document containing an object with keys: a, b.' || chr(10) || '{{' || chr(10) || '  "a": "last",' || chr(10) || '  "b": ' || customer || chr(10) || '}}'
FROM ({_REPEATED} orders) r""")
def json_source(t: Tables):
    docs = t.json_docs.select("doc_id", "text").unionByName(t.sql(_REPEATED + "{orders}").select("doc_id", "text"))
    return I.parse_json(docs).select(
        "doc_id", "shape", "reject_reason", F.when(F.col("shape").isNotNull(), F.substring_index("raw_text", "\n", 1)).alias("first_line"),
        F.when(F.col("doc_id") >= 2000000000, F.col("raw_text")).alias("whole"))


_PAGES = """SELECT conv_id AS doc_id, turn + 1 AS page_no,
  CASE WHEN conv_id % 11 = 0 OR turn % 4 = 3 THEN '  ' ELSE text END AS text FROM """


@query("page_text_assembly", f"""
SELECT doc_id, string_agg('--- Page ' || page_no || ' ---' || chr(10) || {D.strip('text')},
  chr(10) || chr(10) ORDER BY page_no, {D.strip('text')}) AS raw_text, NULL AS reject_reason
FROM ({_PAGES} conversations) p WHERE {D.blank('text')} = false GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, {q(K.NO_PAGE_TEXT_REASON)} FROM ({_PAGES} conversations) p
GROUP BY doc_id HAVING bool_and({D.blank('text')})""")
def page_text_assembly(t: Tables):
    pages = t.sql(_PAGES + "{conversations}")
    return I.assemble_pages(pages).drop("parser_type").unionByName(
        I.pages_without_text(pages), allowMissingColumns=True)


_MAYBE_BLANK = "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN chr(10) || ' ' ELSE text END AS raw_text FROM "


@query("reject_empty", f"""
SELECT doc_id, CASE WHEN {D.blank('raw_text')} THEN {q(K.EMPTY_REASON)} END AS reject_reason
FROM ({_MAYBE_BLANK} documents) d""")
def reject_empty(t: Tables):
    good, refused = I.split_empty(t.sql(_MAYBE_BLANK + "{documents}"))
    return good.unionByName(refused, allowMissingColumns=True).select("doc_id", "reject_reason")


_REQUESTED = """SELECT doc_id, text AS raw_text, CASE doc_id % 5 WHEN 0 THEN 'discovery' WHEN 1 THEN 'auto' WHEN 2 THEN ''
  WHEN 3 THEN 'finance_invoice' END AS requested FROM """


@query("document_build", f"""
SELECT doc_id, sha256(raw_text) AS content_hash, strlen(raw_text) AS size, 'pending' AS status,
  CASE WHEN requested = 'discovery' THEN 'discovery' WHEN coalesce(requested, '') IN ('', 'auto') THEN 'auto_detect'
    ELSE 'template' END AS extraction_mode,
  CASE WHEN coalesce(requested, '') NOT IN ('', 'auto', 'discovery') THEN requested END AS document_type_key
FROM ({_REQUESTED} documents) d""")
def document_build(t: Tables):
    return I.build_documents(t.sql(_REQUESTED + "{documents}")).select(
        "doc_id", "content_hash", "size", "status", "extraction_mode", "document_type_key")


@query("content_duplicates", """
SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc_id FROM documents
GROUP BY sha256(text) HAVING count(*) > 1""")
def content_duplicates(t: Tables):
    return I.content_duplicates(t.documents.select("doc_id", F.sha2(F.col("text"), 256).alias("content_hash")))


# Template definitions written as JSON, one per part, then read back.
def definitions(t: Tables):
    given = F.to_json(F.struct(
        F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("key"),
        F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).alias("name"),
        F.array("p_type").alias("aliases"), F.array(
            F.struct(F.col("p_brand").alias("key"), F.lit(None).cast("string").alias("label"),
                     F.lit(None).cast("string").alias("data_type"), F.lit(True).alias("required"),
                     F.array("p_name", "p_type").alias("aliases"), F.lit(None).cast("double").alias("_")),
            F.struct(F.lit("size").alias("key"), F.lit("Size").alias("label"),
                     F.lit("number").alias("data_type"), F.lit(None).cast("boolean").alias("required"),
                     F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("double").alias("_"))
        ).alias("fields")))
    return t.part.select(F.col("p_partkey").alias("file"), F.from_json(given, TEMPLATE_FILE).alias("d")).select(
        "file", "d.*")


_DEFINED = """
SELECT p_partkey AS template_order, 't' || p_partkey AS template_key,
  CASE WHEN p_partkey % 3 > 0 THEN p_name ELSE 't' || p_partkey END AS name, 0 AS "order", p_brand AS field_key, p_brand AS label,
  'string' AS data_type, true AS required, [p_name, p_type] AS aliases FROM part
UNION ALL SELECT p_partkey, 't' || p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_name ELSE 't' || p_partkey END,
  1, 'size', 'Size', 'number', false, CAST([] AS VARCHAR[]) FROM part"""


@query("template_catalog", f"""
SELECT template_order, template_key, name, 'general' AS industry, '' AS description, "order", field_key, label, data_type,
  required, array_to_string(aliases, '|') AS aliases FROM ({_DEFINED}) d""")
def template_catalog(t: Tables):
    return catalog.template_fields(definitions(t), "file").select(
        "template_order", "template_key", "name", "industry", "description", "order", "field_key", "label",
        "data_type", "required", F.array_join("aliases", "|").alias("aliases"))


@query("template_upsert", f"""
WITH d AS (SELECT template_key, field_key, label, data_type FROM ({_DEFINED}) x),
old AS (SELECT * FROM d UNION ALL SELECT template_key, 'retired', 'Retired', 'string' FROM d WHERE field_key = 'size'),
new AS (SELECT template_key, field_key, upper(label) AS label, data_type FROM d WHERE field_key <> 'size'
  UNION ALL SELECT template_key, 'added', 'Added', 'date' FROM d WHERE field_key = 'size')
SELECT coalesce(n.template_key, o.template_key) AS template_key, coalesce(n.field_key, o.field_key) AS field_key,
  coalesce(n.label, o.label) AS label, coalesce(n.data_type, o.data_type) AS data_type,
  CASE WHEN o.field_key IS NULL THEN 'inserted' WHEN n.field_key IS NULL THEN 'kept' ELSE 'updated' END AS outcome
FROM old o FULL JOIN new n ON o.template_key = n.template_key AND o.field_key = n.field_key""")
def template_upsert(t: Tables):
    d = catalog.template_fields(definitions(t), "file").select("template_key", "field_key", "label", "data_type")
    def extra(key, label, kind):
        return d.filter("field_key = 'size'").select("template_key", F.lit(key).alias("field_key"),
                                                     F.lit(label).alias("label"), F.lit(kind).alias("data_type"))
    loaded = d.filter("field_key <> 'size'").withColumn("label", F.upper("label")).unionByName(
        extra("added", "Added", "date"))
    return catalog.upsert_template_fields(d.unionByName(extra("retired", "Retired", "string")), loaded)


@query("template_nested_view", f"""
SELECT template_key, max(name) AS name, string_agg(field_key || '/' || label || '/' || data_type, '|' ORDER BY "order")
  AS fields FROM ({_DEFINED}) d GROUP BY template_key""")
def template_nested_view(t: Tables):
    nested = catalog.nested_templates(catalog.template_fields(definitions(t), "file"))
    return nested.select("template_key", "name", F.array_join(F.transform("fields", lambda f: F.concat_ws(
        "/", f["field_key"], f["label"], f["data_type"])), "|").alias("fields"))


_REDONE = "SELECT field_id, doc_id, field_name, 'redone ' || field_id AS value FROM "


@query("replace_by_document", f"""
SELECT field_id, doc_id, field_name, value FROM @raw_fields f WHERE doc_id % 3 <> 0
UNION ALL {_REDONE} @raw_fields f WHERE doc_id % 3 = 0 AND field_name <> 'vendor'""")
def replace_by_document(t: Tables):
    old = t.raw_fields.select("field_id", "doc_id", "field_name", "value")
    docs = t.customer.select(F.col("c_custkey").alias("doc_id")).filter("doc_id % 3 = 0")
    new = old.join(docs, "doc_id", "left_semi").filter("field_name <> 'vendor'").withColumn(
        "value", F.concat(F.lit("redone "), F.col("field_id").cast("string")))
    return replace_documents(old, new.select(old.columns), docs)


_REDONE_AGAIN = "SELECT field_id, doc_id, field_name, 'again ' || field_id AS value FROM "


@query("versioned_sink", f"""
SELECT field_id, doc_id, field_name, value FROM @raw_fields f WHERE doc_id % 3 <> 0
UNION ALL {_REDONE} @raw_fields f WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0 AND field_name <> 'vendor'
UNION ALL {_REDONE_AGAIN} @raw_fields f WHERE doc_id % 6 = 0 AND doc_id % 12 <> 0""")
def versioned_sink(t: Tables):
    """Writes all documents, writes a third of them again, then half of these (some without any row left), and reads back."""
    path = new_folder(t)
    rows = t.raw_fields.select("field_id", "doc_id", "field_name", "value")
    docs = t.customer.select(F.col("c_custkey").alias("doc_id"))
    def said(word, which):
        return rows.where(which).withColumn("value", F.concat(F.lit(word), F.col("field_id").cast("string")))
    V.append_documents(path, rows, docs, 1)
    V.append_documents(path, said("redone ", "doc_id % 3 = 0 and field_name <> 'vendor'"), docs.where("doc_id % 3 = 0"), 2)
    V.append_documents(path, said("again ", "doc_id % 6 = 0 and doc_id % 12 <> 0"), docs.where("doc_id % 6 = 0"), 3)
    V.compact_documents(t.spark, path, f"{path}-compact")
    return V.read_documents(t.spark, f"{path}-compact")


@query("original_preview", """
SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN text ELSE 'parsed ' || doc_id END AS original_preview FROM documents""")
def original_preview(t: Tables):
    mark = F.decode(F.unhex(F.lit("EFBBBF")), "UTF-8")
    docs = t.documents.select(
        "doc_id", F.encode(F.concat(mark, F.col("text")), "UTF-8").alias("content"),
        F.when(F.col("doc_id") % 4 == 0, "json").otherwise("pdf_text").alias("parser_type"),
        F.when(F.col("doc_id") % 4 == 1, "Text/HTML; charset=utf-8").alias("content_type"),
        F.concat(F.lit("parsed "), F.col("doc_id").cast("string")).alias("raw_text"))
    return I.original_preview(docs).select("doc_id", "original_preview")
