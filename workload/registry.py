"""Registration of queries, access to the tables, and inputs written once for both engines."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


#: Into how many partitions every table is dealt before a query works on it; None: as its files are. Set by deal_out().
PARTITIONS: int | None = None


def deal_out(partitions: int | None) -> None:
    """For tables of few large files with one row group each, which the scan can't split. The same at every size of the tables."""
    global PARTITIONS
    PARTITIONS = partitions


class Tables:
    """The tables of one folder, and derived inputs by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            rows = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return rows.repartition(PARTITIONS) if PARTITIONS else rows
        return self.sql(INPUTS[name])

    def sql(self, text: str) -> DataFrame:
        used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(render(text, SPARK, keep=True), **used)


def query(name: str, oracle: str | None = None):
    """Register a query over ``Tables``; ``oracle`` is its check in DuckDB's SQL."""
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, folder))
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = duck(oracle)
        return fn
    return register


def new_folder(t: Tables) -> str:
    """A new folder below the one the session names; a local one only for a local session."""
    named, master = t.spark.conf.get("spark.checkpoint.dir", None), t.spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{(named or tempfile.mkdtemp(prefix='run-')).rstrip('/')}/{uuid.uuid4().hex}"


# --- two dialects ----------------------------------------------------------------------------

SPARK = {"seq": "explode(sequence(0, {n} - 1))", "at": "timestamp_seconds({x})",
         "show": "date_format({x}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')",
         "json": "to_json(named_struct({x}))", "as_ts": "CAST({x} AS TIMESTAMP)"}
DUCK = {"seq": "unnest(range(0, {n}))", "at": "make_timestamp(({x}) * 1000000)",
        "show": "strftime({x}, '%Y-%m-%d %H:%M:%S.%f')", "json": "json_object({x})",
        "as_ts": "CAST({x} AS TIMESTAMP)"}


def render(text: str, dialect: dict, keep: bool = False) -> str:
    """Fill in `<<macro:argument>>`, innermost first; table names stay in braces for Spark."""
    while "<<" in text:
        start = text.rindex("<<")
        end = text.index(">>", start)
        name, _, arg = text[start + 2:end].partition(":")
        body = dialect[name].replace("{n}", arg).replace("{x}", arg)
        text = text[:start] + body + text[end + 2:]
    if not keep:
        for t in TABLES:
            text = text.replace("{" + t + "}", t)
    return text


def duck(text: str) -> str:
    """An oracle statement; `@name` stands for a derived input as a sub-query."""
    for name in sorted(INPUTS, key=len, reverse=True):
        text = text.replace("@" + name, "(" + INPUTS[name] + ")")
    return render(text, DUCK)


def q(text: str) -> str:
    """A SQL string literal for DuckDB."""
    return "'" + text.replace("'", "''") + "'"


# --- derived inputs ----------------------------------------------------------------------------

_DATE = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"
_NL = " || chr(10) || "

INPUTS: dict[str, str] = {}

# Labelled business documents of the four kinds the bundled templates describe, one per order.
INPUTS["business"] = f"""
SELECT o_orderkey AS doc_id, 'plain_text' AS parser_type,
  CASE o_orderkey % 4
  WHEN 0 THEN 'Finance: Invoice'{_NL}'Invoice Number: INV-' || o_orderkey{_NL}
    CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'Vendor = "Supplier ' || o_custkey || '"' || chr(10) END
    || '- Customer Name - Customer#' || o_custkey{_NL}'Invoice Date: '
    || CASE WHEN o_orderkey % 13 = 0 THEN '31/02/2026' ELSE {_DATE} END{_NL}
    'Total Amount: USD ' || {_PRICE}{_NL}'Currency: '
    || CASE WHEN o_orderkey % 17 = 0 THEN 'RMM' ELSE 'USD' END || chr(10)
  WHEN 1 THEN 'Purchase Order'{_NL}'1. PO_Number: PO-' || o_orderkey{_NL}'Project: Job ' || o_custkey{_NL}
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'Site: Yard ' || o_custkey || chr(10) END
    || 'Supplier Name: S' || o_custkey{_NL}'Order Date: ' || {_DATE}{_NL}'Order total: RM ' || {_PRICE}{_NL}
    'Contact: buyer' || o_custkey || '@example.com' || chr(13) || chr(10)
  WHEN 2 THEN 'Progress claim for the works'{_NL}'Claim No: C-' || o_orderkey{_NL}
    'Contract No: K-' || o_custkey{_NL}'Project Name: Tower ' || o_custkey{_NL}
    'Contractor: Builder ' || o_custkey{_NL}'Period To: ' || {_DATE}{_NL}'Claim Amount: MYR ' || {_PRICE}{_NL}
    'Work Completed %: ' || (o_orderkey % 150) || '%' || chr(10)
  ELSE 'Meeting note' || chr(10){_NL}'  Discussed order with customer ' || o_custkey{_NL}
    'Budget $1,250.00 agreed on ' || {_DATE}{_NL}'Call 03-1234 5678 or mail c.' || o_custkey
    || '@mail.example.org' || chr(10) END AS text
FROM {{orders}}"""

# The prose table and the business documents as one document table.
INPUTS["all_texts"] = f"""
SELECT doc_id, 'plain_text' AS parser_type, text FROM {{documents}}
UNION ALL SELECT doc_id + 1000000000, parser_type, text FROM ({INPUTS['business']}) b"""

# Extracted fields before any template: six per order, a customer's orders being one document.
INPUTS["raw_fields"] = f"""
SELECT field_id, field_id AS pos, doc_id, field_name, value, confidence, auto_accept,
  'snippet ' || field_id AS snippet, 'Found by rule.' AS reasoning,
  CASE doc_id % 5 WHEN 0 THEN 'finance_invoice' WHEN 1 THEN 'construction_purchase_order'
    WHEN 2 THEN 'finance_bank_statement' WHEN 3 THEN 'construction_progress_claim' END AS doc_template
FROM (SELECT k * 6 + j AS field_id, doc_id,
  CASE j WHEN 0 THEN 'Invoice No' WHEN 1 THEN 'vendor' WHEN 2 THEN 'Total' WHEN 3 THEN 'date'
    WHEN 4 THEN 'records[' || (k % 12) || '].Due' ELSE 'Ship Notes ' || (k % 3) END AS field_name,
  CASE j WHEN 0 THEN CASE WHEN k % 11 = 0 THEN '' ELSE 'INV-' || k END
    WHEN 1 THEN 'Supplier ' || doc_id
    WHEN 2 THEN CASE k % 5 WHEN 0 THEN 'abc' WHEN 1 THEN 'RM ' || price WHEN 2 THEN '-' || price ELSE price END
    WHEN 3 THEN CASE k % 6 WHEN 0 THEN '31/02/2026' WHEN 1 THEN '2026.06.09' WHEN 2 THEN '5/6/26' ELSE day END
    WHEN 4 THEN day ELSE priority END AS value,
  CAST((k * 7 + j * 13) % 101 AS DOUBLE) / 100 AS confidence, (k + j) % 3 <> 0 AS auto_accept
FROM (SELECT o_orderkey AS k, o_custkey AS doc_id, {_DATE} AS day, {_PRICE} AS price,
        o_orderpriority AS priority, <<seq:6>> AS j FROM {{orders}}) o) f"""

# Stored fields with their decisions.
INPUTS["stored_fields"] = f"""
SELECT field_id, pos, doc_id, doc_template, field_name, value AS extracted_value, value, confidence, snippet,
  CASE WHEN j < 4 THEN CASE j WHEN 0 THEN 'invoice_number' WHEN 1 THEN 'supplier_name'
    WHEN 2 THEN 'total_amount' ELSE 'invoice_date' END END AS standard_field_key,
  CASE j WHEN 0 THEN 'string' WHEN 1 THEN 'string' WHEN 2 THEN 'currency' WHEN 3 THEN 'date'
    ELSE 'suggestion' END AS data_type, j < 4 AS required,
  CASE WHEN j = 5 AND field_id % 9 = 2 THEN
      'Manually added by reviewer because this field was absent from the extracted fields. Not generated by AI.'
    WHEN field_id % 4 = 0 THEN 'AI provider=p' || (doc_id % 3) || ', model=m' || (doc_id % 2) || '.5. Seen in text.'
    ELSE 'Found by rule.' END AS reasoning,
  status AS validation_status, 'checked' AS validation_message,
  field_id % 4 = 0 AND status = 'valid' AS accepted,
  NOT (field_id % 4 = 0 AND status = 'valid') AND field_id % 5 < 3 AS needs_review,
  CASE WHEN field_id % 4 = 0 AND status = 'valid' THEN 'system' END AS accepted_by
FROM (SELECT r.*, r.field_id % 6 AS j, CASE (r.field_id * 3) % 7 WHEN 0 THEN 'invalid'
    WHEN 1 THEN 'missing_required' WHEN 2 THEN 'not_applicable' ELSE 'valid' END AS status
  FROM ({INPUTS['raw_fields']}) r) s"""

# Documents of the application: one per customer.
INPUTS["app_documents"] = """
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 <> 0 THEN 'file_' || c_custkey || '.txt' END AS filename,
  CASE c_custkey % 3 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/json' END AS content_type,
  CASE c_custkey % 5 WHEN 0 THEN 'plain_text' WHEN 1 THEN 'raw_text' WHEN 2 THEN 'json' WHEN 3 THEN 'csv'
    END AS parser_type,
  CASE c_custkey % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' WHEN 3 THEN 'error'
    ELSE 'needs_review' END AS status,
  CASE c_custkey % 3 WHEN 0 THEN 'auto_detect' WHEN 1 THEN 'discovery' ELSE 'template' END AS extraction_mode,
  CASE c_custkey % 5 WHEN 0 THEN 'finance_invoice' WHEN 1 THEN 'construction_purchase_order' END AS document_type_key,
  CASE c_custkey % 5 WHEN 0 THEN 'Finance: Invoice' WHEN 1 THEN 'Construction: Purchase Order' END AS document_type_label,
  'Account of ' || c_name || ' in ' || c_mktsegment AS raw_text,
  CASE WHEN c_custkey % 7 = 3 THEN 'Failed on ' || c_mktsegment END AS error_message,
  'deterministic' AS strategy,
  <<at:1700000000 + (c_custkey * 7919) % 1000003>> AS created_at,
  <<at:1710000000 + (c_custkey * 104729) % 1000003>> AS updated_at
FROM {customer}"""

INPUTS["correction_log"] = """
SELECT event_id AS correction_id, field_id, 'x' AS old_value, 'user_' || (event_id % 7) AS corrected_by,
  <<as_ts:ts>> AS corrected_at,
  CASE event_id % 5 WHEN 0 THEN 'INV-' || CAST(floor(field_id / 6) AS BIGINT)
    WHEN 1 THEN '  inv-' || CAST(floor(field_id / 6) AS BIGINT) WHEN 2 THEN '' WHEN 3 THEN 'Supplier ' || user_id
    ELSE 'Changed ' || event_id END AS corrected_value
FROM (SELECT *, (event_id * 31) % 6007 AS field_id FROM {events}) e"""

INPUTS["audit_log"] = """
SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN user_id END AS doc_id,
  CASE event_type WHEN 'signup' THEN 'field_manually_added' ELSE event_type END AS action,
  'user_' || (event_id % 7) AS actor, 'event ' || event_id AS details, <<as_ts:ts>> AS created_at
FROM {events}"""

# Reviewer actions. Few fields and documents get most of them.
INPUTS["actions"] = """
SELECT event_id AS action_id, <<as_ts:ts>> AS ts, user_id AS doc_id, 'user_' || (event_id % 7) AS actor,
  CASE event_type WHEN 'click' THEN 'correct' WHEN 'view' THEN 'accept' WHEN 'signup' THEN 'add'
    WHEN 'purchase' THEN 'remove' ELSE 'reject' END AS kind,
  CASE WHEN event_id % 3 = 0 THEN event_id % 6 ELSE (event_id * 31) % 907 END AS field_id,
  CASE event_id % 9 WHEN 0 THEN ' New name ' WHEN 1 THEN '   ' WHEN 2 THEN 'Invoice No' END AS field_name,
  CASE event_id % 5 WHEN 0 THEN 'RM ' || user_id WHEN 1 THEN '2024-01-0' || (1 + event_id % 9)
    WHEN 2 THEN CASE WHEN event_id % 4 = 0 THEN ' ' ELSE 'fixed' END WHEN 3 THEN 'fixed' END AS value,
  CASE WHEN event_id % 2 = 0 THEN 'seen on page ' || event_id END AS source_snippet,
  CASE event_id % 4 WHEN 0 THEN 'duplicate_document' WHEN 1 THEN 'unheard_of' WHEN 2 THEN '' END AS reason_code,
  CASE WHEN event_id % 3 = 0 THEN ' see note ' || event_id END AS reason
FROM {events}"""

INPUTS["jobs"] = """
SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 97 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS doc_id,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'queued' ELSE
    CASE WHEN o_orderkey % 2 = 0 THEN 'running' ELSE 'succeeded' END END AS status,
  CAST(o_orderkey % 4 AS INT) AS attempts, CASE WHEN o_orderkey % 3 = 0 THEN 'quota' END AS deferred_reason,
  CASE WHEN o_orderkey % 5 > 0 THEN <<as_ts:o_orderdate>> END AS next_retry_at,
  <<as_ts:o_orderdate>> AS created_at, <<as_ts:o_orderdate>> AS started_at,
  CASE WHEN o_orderkey % 2 = 0 THEN <<as_ts:o_orderdate>> END AS finished_at
FROM {orders}"""

INPUTS["requests"] = """
SELECT event_id AS request_id, <<as_ts:ts>> AS ts, 'p' || (user_id % 2) AS provider, 'm1' AS model FROM {events}"""

# JSON documents: objects, arrays of objects, scalars and broken text, one per order.
_OBJECT = f"""chr(123) || '"customer":' || o_custkey || ',"day":"' || {_DATE} || '","lines":[' || chr(123)
  || '"no":1,"price":' || {_PRICE} || chr(125) || ',' || chr(123) || '"no":2,"tags":["a",null]' || chr(125)
  || '],"note":null,"open":true,"z":' || chr(123) || '"deep":' || chr(123) || '"x":1.0' || chr(125) || chr(125) || chr(125)"""
_ARRAY = f"""'[' || chr(123) || '"id":' || o_orderkey || ',"priority":"' || o_orderpriority || '"' || chr(125) || ',' || chr(123)
  || '"price":' || {_PRICE} || ',"tags":["x",' || o_custkey || '],"w":' || chr(123) || '"w":' || o_custkey || chr(125) || chr(125)
  || ',"loose",' || chr(123) || '"id":null' || chr(125) || ']'"""
INPUTS["json_docs"] = f"""
SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN {_OBJECT} WHEN 1 THEN {_ARRAY}
  WHEN 2 THEN '"' || o_orderpriority || '"' WHEN 3 THEN CAST(o_custkey AS STRING)
  WHEN 4 THEN '[' || {_PRICE} || ',' WHEN 5 THEN {_OBJECT} || ' trailing' END AS text FROM {{orders}}"""

# CSV documents with their own separator, a quoted cell, a short and a surplus row.
_SEP = "CASE o_orderkey % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE '|' END"
INPUTS["csv_docs"] = f"""
SELECT doc_id, customer, price, 'key' || s || 'note' || s || 'price' || chr(10) || doc_id || s || '"say ""hi""' || s
  || ' ' || customer || '"' || s || price || chr(13) || chr(10)
  || CASE WHEN doc_id % 5 = 0 THEN 'short' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 7 = 0 THEN 'a' || s || s || 'c' || s || 'd' || s || 'e' || chr(10) ELSE '' END AS text, s AS sep
FROM (SELECT o_orderkey AS doc_id, o_custkey AS customer, {_PRICE} AS price, {_SEP} AS s FROM {{orders}}) o"""

# One record per order, a customer's orders being one record set.
INPUTS["order_rows"] = f"""
SELECT o_custkey AS doc_id, o_orderkey AS order_key, {_DATE} AS day,
  CASE WHEN o_orderkey % 8 = 0 THEN ' ' WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  {_PRICE} AS price FROM {{orders}}"""

# Model responses in every state they arrive in, one per order.
_FIELD = f"""chr(123) || '"field_name":" total ","value":"' || {_PRICE} || '","confidence":' || (o_orderkey % 130) || ',"source_snippet":"Total ' || o_orderkey || '"' || chr(125)"""
_OTHER = f"""chr(123) || '"name":"payer","extracted_value":' || o_custkey || ',"confidence_score":"high","reasoning":"seen"' || chr(125)"""
_EMPTY = """chr(123) || '"field_name":"gone","value":null' || chr(125) || ',' || chr(123) || '"value":"nameless"' || chr(125) || ',"loose"'"""
_BODY = f"""chr(123) || '"fields":[' || {_FIELD} || ',' || {_OTHER} || ',' || {_EMPTY} || ']' || chr(125)"""
INPUTS["responses"] = f"""
SELECT o_orderkey AS doc_id, 'p' || (o_custkey % 2) AS provider, 'm1' AS model, CASE o_orderkey % 5
  WHEN 0 THEN '```json' || chr(10) || {_BODY} || chr(10) || '```' WHEN 1 THEN 'Here you are: ' || {_BODY} || ' - done'
  WHEN 2 THEN '[1, 2]' WHEN 3 THEN {_BODY} ELSE 'no json ' || chr(123) || ' at all' END AS response, {_PRICE} AS price,
  o_custkey AS customer FROM {{orders}}"""
_REVIEW = f"""chr(123) || '"summary":" Order ' || o_orderkey || ' ","confidence":' || (o_orderkey % 130) || ',"quality":"Needs Review"'
  || CASE o_orderkey % 3 WHEN 0 THEN ',"issues":["late",""," ' || o_custkey || ' "]' WHEN 1 THEN ',"issues":[],"potential_issues":"one only"' ELSE '' END
  || ',"consistency_checks":["sum ok"]' || chr(125)"""
INPUTS["review_responses"] = f"""
SELECT o_orderkey AS doc_id, 'p1' AS provider, 'm1' AS model, o_custkey AS customer, CASE WHEN o_orderkey % 4 = 3 THEN 'nothing useful'
  WHEN o_orderkey % 4 = 2 THEN '```' || {_REVIEW} || '```' ELSE {_REVIEW} END AS response FROM {{orders}}"""
