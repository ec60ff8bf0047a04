"""Structured records -> one field row per cell or JSON leaf."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from fieldmill import constants as K
from fieldmill.functions import json_tree
from fieldmill.functions.common import bind, is_blank, strings
from fieldmill.operators.ingest import named_cells, strict_json, utf8
from fieldmill.schemas import FIELD, field, source_span


def records_to_fields(records: DataFrame) -> DataFrame:
    """Records (doc_id, record, cells) -> field rows `records[i].name`; blank cells need a look."""
    cell = records.select("doc_id", F.col("record").cast("bigint").alias("record"),
                          F.posexplode("cells").alias("_c", "_cell"))
    item = csv_cell(F.col("record"), F.col("_cell"))
    # record and column together order the cells; no ranking is needed
    return (cell.select("doc_id", "record", F.col("_c").alias("column_pos"), item.alias("_f"))
            .select("doc_id", "record", "column_pos", "_f.*"))


def schema_keys(records: DataFrame) -> DataFrame:
    """Union of the record keys per document in first-seen order -> doc_id, schema_keys.

    Each key is reduced to its first place before and after the shuffle; what is collected is the
    width of the schema, not the number of records.
    """
    seen = (records.select("doc_id", "record", F.posexplode("cells").alias("_c", "_cell"))
            .groupBy("doc_id", F.col("_cell.name").alias("key"))
            .agg(F.min(F.struct("record", "_c")).alias("first")))
    return seen.groupBy("doc_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("first", "key"))), lambda s: s["key"]).alias("schema_keys"))


def dataset_summary(records: DataFrame, kind: str = "csv", documents: DataFrame | None = None) -> DataFrame:
    """The five leading rows of a record set (JSON without object keys has four).

    ``documents`` (doc_id) adds the sets that have no record.
    """
    noun, listed = ("CSV", " with columns: ") if kind == "csv" else ("JSON", " with fields: ")
    why = K.DATASET_REASONS[kind]
    type_name = "structured_csv" if kind == "csv" else "structured_json_array"
    counts = records.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if documents is not None:
        counts = documents.select("doc_id").join(counts, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    both = counts.join(schema_keys(records), "doc_id", "left")
    keys = F.coalesce(F.array_join("schema_keys", ", "), F.lit(""))
    n = F.col("n").cast("string")
    summary = F.concat(n, F.lit(f" {noun} record(s)"), F.when(
        keys != "", F.concat(F.lit(listed), keys, F.lit("."))).otherwise("."))
    head = [
        field("document_type", type_name, 1.0, summary, why[0], True),
        field("summary", summary, 1.0, summary, why[1], True),
        field("record_count", n, 1.0, F.concat(
            F.lit("CSV row count: " if kind == "csv" else "Array length: "), n), why[2], True),
        field("schema_fields", keys, 1.0, keys, why[3], True),
        field("primary_entity", "structured_records", 0.95, summary, why[4], True),
    ]
    items = F.array(*head)
    if kind != "csv":
        items = F.when(keys != "", items).otherwise(F.array(*head[:3], head[4]))
    return both.select("doc_id", F.posexplode(items).alias("pos", "_f")).select("doc_id", "pos", "_f.*")


def csv_text(headers: Column, rows: Column, preview_rows: int = 10) -> Column:
    """The readable text of one CSV document: size line, columns, first rows, omitted line."""
    number = lambda c: c.cast("string")
    pair = lambda c: F.concat(c["name"], F.lit(": "), F.coalesce(c["value"], F.lit("None")))
    line = lambda row, i: F.concat(F.lit("Preview row "), number(i + 1), F.lit(": "), F.array_join(
        F.transform(named_cells(headers, row), pair), "; "))
    shown = F.transform(F.slice(rows, F.lit(1), F.lit(preview_rows)), line)
    return F.array_join(F.array_compact(F.array(
        F.concat(F.lit("CSV document with "), number(F.size(rows)), F.lit(" rows and "), number(F.size(headers)), F.lit(" columns.")),
        F.when(F.size(headers) > 0, F.concat(F.lit("Columns: "), F.array_join(headers, ", "))),
        F.when(F.size(rows) > 0, F.array_join(shown, "\n")),
        F.when(F.size(rows) > preview_rows, F.concat(F.lit("... "), number(F.size(rows) - preview_rows),
                                                     F.lit(" additional rows omitted from preview."))))), "\n")


def csv_fields(parsed: DataFrame) -> DataFrame:
    """Parsed CSV documents (doc_id, headers, rows) -> doc_id, pos, field columns: the describing rows, then every cell as written.

    Other columns are carried along. All of it happens in the document's row; records_to_fields and dataset_summary do the same for records in rows of their own.
    """
    headers, rows = F.col("headers"), F.col("rows")
    keys = F.when(F.size(rows) > 0, F.concat(headers, F.when(
        F.exists(rows, lambda r: F.size(r) > F.size(headers)), F.array(F.lit("null"))).otherwise(F.array().cast("array<string>"))))
    names = F.array_join(F.array_distinct(F.coalesce(keys, F.array().cast("array<string>"))), ", ")
    n, why = F.size(rows).cast("string"), K.DATASET_REASONS["csv"]
    summary = F.concat(n, F.lit(" CSV record(s)"), F.when(names != "", F.concat(F.lit(" with columns: "), names, F.lit("."))).otherwise("."))

    def described(v):
        return F.array(field("document_type", "structured_csv", 1.0, F.left(v["text"], F.lit(220)), why[0], True),
                       field("summary", v["summary"], 1.0, v["summary"], why[1], True),
                       field("record_count", n, 1.0, F.concat(F.lit("CSV row count: "), n), why[2], True),
                       field("schema_fields", v["names"], 1.0, v["names"], why[3], True),
                       field("primary_entity", "structured_records", 0.95, F.left(v["text"], F.lit(160)), why[4], True))

    cells = F.flatten(F.transform(rows, lambda row, i: F.transform(named_cells(headers, row), lambda c: csv_cell(i.cast("bigint"), c))))
    heads = bind(F.struct(csv_text(headers, rows).alias("text"), summary.alias("summary"), names.alias("names")), described)
    every = F.concat(heads.cast(f"array<{FIELD}>"), cells.cast(f"array<{FIELD}>"))
    # the outer form, as Spark would work out the array again to filter on its size before the other one
    carry = [c for c in parsed.columns if c not in ("doc_id", "headers", "rows")]
    rows = parsed.select("doc_id", *carry, F.posexplode_outer(every).alias("pos", "_f")).where("pos is not null")
    return rows.select("doc_id", *carry, F.col("pos").cast("bigint").alias("pos"), "_f.*")


def csv_cell(record: Column, cell: Column) -> Column:
    """The field of one cell (name, value) of a record; a blank cell needs a look."""
    value = F.coalesce(cell["value"], F.lit(""))
    name = F.concat(F.lit("records["), record.cast("string"), F.lit("]."), cell["name"])
    blank = is_blank(value)
    return field(name, value, F.when(blank, 0.75).otherwise(1.0), F.left(F.concat(name, F.lit(": "), value), F.lit(500)),
                 F.when(blank, K.CSV_BLANK_REASON).otherwise(K.CSV_CELL_REASON), ~blank, source_span(row=record + 1, column=cell["name"]))


# --- JSON ------------------------------------------------------------------------------------

#: Rows that an Arrow function gathers before it hands them on.
ROWS = 20_000
WHY = [K.JSON_LEAF_REASON, K.JSON_ITEM_REASON, *K.DATASET_REASONS["json"], *K.OBJECT_REASONS, K.JSON_SCALAR_REASON]
LEAF, ITEM, ARRAY, OBJECT, SCALAR, SCALAR_VALUE = 0, 1, 2, 7, 10, 11


def spread(batch: pa.RecordBatch, keep: list[str], rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of the columns `keep` and what `rows` yields: (number of the input row, *values)."""
    while held := list(islice(rows, ROWS)):
        at, *columns = zip(*held, strict=True)
        made = [utf8(list(c)) if f.type == pa.string() else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.select(keep).take(pa.array(at)).columns, *made], [*keep, *schema.names])


def flatten(df: DataFrame, text: str = "text", max_depth: int | None = None) -> DataFrame:
    """JSON texts -> one row per leaf: the other columns, pos (0, 1, ... as written), path, leaf, too_deep.

    Each text is parsed once, in its row, and a document costs what its own leaves cost. With ``max_depth``, a container below is
    kept as its JSON text and marked. Empty containers and texts that are no JSON have no leaves.
    """
    others = [c for c in df.columns if c != text]
    schema = pa.schema([("pos", pa.int64()), ("path", pa.string()), ("leaf", pa.string()), ("too_deep", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((i, pos, *leaf) for i, value in enumerate(map(json_tree.parse, batch.column(text).to_pylist()))
                    if value is not json_tree.INVALID for pos, leaf in enumerate(json_tree.leaves(value, max_depth)))
            yield from spread(batch, others, rows, schema)

    new = StructType([StructField("pos", LongType()), StructField("path", StringType()), StructField("leaf", StringType()),
                      StructField("too_deep", BooleanType())])
    return df.mapInArrow(read, StructType([*[df.schema[c] for c in others], *new]))


def head_rows(value: object) -> Iterator[tuple]:
    """(name, value, confidence, snippet, reason number) of the rows that describe a whole JSON value."""
    start = json_tree.readable(value, 220)
    if isinstance(value, list):
        keys = ", ".join(dict.fromkeys(k for item in value if isinstance(item, dict) for k in item))
        summary = f"{len(value)} JSON record(s)" + (f" with fields: {keys}." if keys else ".")
        yield "document_type", "structured_json_array", 1.0, start[:220], ARRAY
        yield "summary", summary, 1.0, summary, ARRAY + 1
        yield "record_count", str(len(value)), 1.0, f"Array length: {len(value)}", ARRAY + 2
        if keys:
            yield "schema_fields", keys, 1.0, keys, ARRAY + 3
        yield "primary_entity", "structured_records", 0.95, start[:160], ARRAY + 4
    elif isinstance(value, dict):
        keys = ", ".join(value)
        yield "document_type", "structured_json_object", 1.0, start[:220], OBJECT
        yield "summary", f"JSON object with fields: {keys}.", 1.0, keys, OBJECT + 1
        yield "schema_fields", keys, 1.0, keys, OBJECT + 2
    else:
        yield "document_type", f"structured_json_{json_tree.shape(value)}", 1.0, start[:220], SCALAR
        yield "value", json.dumps(value, ensure_ascii=False), 1.0, start[:220], SCALAR_VALUE


def leaf_rows(value: object, max_depth: int | None) -> Iterator[tuple]:
    """The rows of the leaves. Below a list, a member's value is flattened on its own, so a list under k shows as
    `records[i].k.records[j]`, and a single inner name equal to k collapses into it."""
    if isinstance(value, dict):
        for path, leaf, _ in json_tree.leaves(value, max_depth):
            yield path, leaf, 1.0, None, LEAF
    for i, item in enumerate(value if isinstance(value, list) else []):
        if not isinstance(item, dict):
            yield f"records[{i}]", json.dumps(item, ensure_ascii=False), 1.0, None, ITEM
            continue
        for key, child in item.items():
            name = f"records[{i}].{key}"
            for path, leaf, _ in json_tree.leaves(child, max_depth):
                yield name if path == key or not isinstance(child, dict | list) else f"{name}.{path}", leaf, 1.0, None, LEAF


def json_fields(docs: DataFrame, max_depth: int | None = None, leaves: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """JSON documents (doc_id, text, and columns to carry along) -> field rows: doc_id, the carried, shape, is_head, pos, and the field columns.

    pos numbers the rows of a document as they are written, the describing rows first. A text that is not one JSON value has
    one row without shape, pos and field. One parse a document, no shuffle; a document's rows leave in batches. Without ``leaves``
    only the describing rows are made.
    """
    schema = pa.schema([("shape", pa.string()), ("is_head", pa.bool_()), ("pos", pa.int64()), ("name", pa.string()), ("value", pa.string()),
                        ("confidence", pa.float64()), ("snippet", pa.string()), ("why", pa.int32())])

    def rows_of(i: int, text: str | None) -> Iterator[tuple]:
        value = json_tree.parse(text)
        if value is json_tree.INVALID:
            yield i, None, False, None, None, None, None, None, None
            return
        kind, pos = json_tree.shape(value), 0
        for head, rows in ((True, head_rows(value)), (False, leaf_rows(value, max_depth) if leaves else ())):
            for row in rows:
                yield i, kind, head, pos, *row
                pos += 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = (row for i, text in enumerate(batch.column("text").to_pylist()) for row in rows_of(i, text))
            yield from spread(batch, ["doc_id", *carry], every, schema)

    kinds = [StringType(), BooleanType(), LongType(), StringType(), StringType(), DoubleType(), StringType(), IntegerType()]
    found = docs.select("doc_id", *carry, "text").mapInArrow(read, StructType(
        [docs.schema["doc_id"], *[docs.schema[c] for c in carry], *[StructField(f.name, kind) for f, kind in zip(schema, kinds, strict=True)]]))
    snippet = F.coalesce("snippet", F.left(F.concat("name", F.lit(": "), "value"), F.lit(500)))
    path = F.when(~F.col("is_head"), F.col("name"))
    item = field(F.col("name"), F.col("value"), F.col("confidence"), snippet, F.get(strings(WHY), F.col("why")), True,
                 F.when(path.isNotNull(), source_span(json_path=path)))
    return found.select("doc_id", *carry, "shape", "is_head", "pos", F.when(F.col("shape").isNotNull(), item).alias("_f")).select(
        "doc_id", *carry, "shape", "is_head", "pos", "_f.*")


def _of_shape(docs: DataFrame, max_depth: int | None, *which: str, heads: bool = True) -> DataFrame:
    rows = json_fields(docs, max_depth).where(F.col("shape").isNotNull())
    rows = rows.where(F.col("shape").isin(*which) if which else ~F.col("shape").isin("array", "object"))
    return (rows if heads else rows.where("not is_head")).drop("shape", "is_head")


def json_array_fields(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The leaves of JSON arrays (doc_id, text) as `records[i].key[.suffix]` rows, with pos."""
    return _of_shape(docs, max_depth, "array", heads=False)


def json_object_fields(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """JSON objects (doc_id, text) -> type, summary and key rows, then one row per leaf, with pos."""
    return _of_shape(docs, max_depth, "object")


def json_scalar_fields(docs: DataFrame) -> DataFrame:
    """JSON scalars (doc_id, text) -> `structured_json_<kind>` and the value, with pos."""
    return _of_shape(docs, None)


def embedded_json(text: Column) -> Column:
    """The JSON value that starts at the first [ or { of a text, or NULL."""
    starts = F.least(F.nullif(F.instr(text, "["), F.lit(0)), F.nullif(F.instr(text, "{"), F.lit(0)))
    return strict_json(F.substring(text, starts, F.length(text)))


def embedded_csv_records(text: Column) -> Column:
    """The JSON list after the CSV marker as array<map>; items that are no objects are wrapped."""
    payload = F.when(F.contains(text, F.lit(K.CSV_MARKER)),
                     F.substring_index(F.substring(text, F.instr(text, K.CSV_MARKER), F.length(text)),
                                       K.CSV_MARKER, -1))
    items = F.from_json(payload, "array<string>")
    return F.transform(items, lambda x: F.when(
        F.startswith(x, F.lit("{")), F.from_json(x, "map<string,string>")
    ).otherwise(F.create_map(F.lit("value"), x)))
