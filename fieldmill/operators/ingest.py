"""Raw content -> parsed documents, refused documents, previews and duplicate reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fieldmill import constants as K
from fieldmill.functions import json_tree
from fieldmill.functions.common import bind, is_blank, strip

#: JSON documents that an Arrow function works on at once.
JSON_SLICE = 500
BOM = "^﻿"


def format_of(filename: Column, content_type: Column) -> Column:
    """text / csv / json / pdf by suffix or MIME type, tested in that order; else NULL."""
    suffix = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"[^/](\.[^./]+)$", 1))
    mime = F.lower(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1)))
    chain = F
    for name, suffixes, types in (("text", K.TEXT_SUFFIXES, K.TEXT_TYPES),
                                  ("csv", K.CSV_SUFFIXES, K.CSV_TYPES),
                                  ("json", K.JSON_SUFFIXES, K.JSON_TYPES),
                                  ("pdf", K.PDF_SUFFIXES, K.PDF_TYPES)):
        chain = chain.when(suffix.isin(suffixes) | mime.isin(types), name)
    return chain.otherwise(F.lit(None).cast("string"))


def route_format(uploads: DataFrame) -> DataFrame:
    """Adds ``format`` and, where there is none, ``reject_reason``."""
    return (uploads.withColumn("format", format_of(F.col("filename"), F.col("content_type")))
            .withColumn("reject_reason", F.when(F.col("format").isNull(), K.UNSUPPORTED_REASON)))


def decode(content: Column, drop_bom: bool = False) -> Column:
    """UTF-8 bytes to text; invalid bytes become the replacement character."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.regexp_replace(text, BOM, "") if drop_bom else text


def parse_text(uploads: DataFrame) -> DataFrame:
    """Text uploads (doc_id, content) -> raw_text, parser_type, preview."""
    return _parsed(uploads, decode(F.col("content")), "plain_text")


def parse_inline(texts: DataFrame) -> DataFrame:
    """Pasted text (doc_id, text) -> the same columns."""
    return (_parsed(texts, F.col("text"), "raw_text").withColumn("filename", F.lit("raw-text.txt")))


def _parsed(df: DataFrame, text: Column, parser: str) -> DataFrame:
    return (df.withColumn("raw_text", text).withColumn("parser_type", F.lit(parser))
            .withColumn("preview", F.left("raw_text", F.lit(500))))


# --- CSV -------------------------------------------------------------------------------------

def sniff_separator(text: Column) -> Column:
    """The most frequent of , ; tab | in the first 4096 characters; comma when none occurs."""
    head = F.left(text, F.lit(4096))
    counts = F.array(*[
        F.struct(F.regexp_count(head, F.lit(pattern)).alias("n"), F.lit(-rank).alias("r"),
                 F.lit(sep).alias("sep"))
        for rank, (sep, pattern) in enumerate([(",", ","), (";", ";"), ("\t", "\t"), ("|", "[|]")])])
    return F.array_max(counts)["sep"]


def csv_rows(text: Column, separator: Column) -> Column:
    """array<array<string>> of the non-empty rows.

    A quote opens a quoted cell only where a cell starts; such a cell may hold separators and line ends, and what
    follows its closing quote belongs to it. Any other quote is a character like the rest.
    """
    quoted = r'"(?:[^"]++|"")*+"?+'
    joined = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    find = lambda where, pattern, group: F.call_function("regexp_extract_all", where, pattern, F.lit(group))

    def cell_text(cell):
        inner = F.regexp_extract(cell, r'^"((?:[^"]++|"")*+)', 1)
        rest = F.regexp_extract(cell, r'^"(?:[^"]++|"")*+"?+([\s\S]*)$', 1)
        return F.when(F.startswith(cell, F.lit('"')), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest)).otherwise(cell)

    def rows(sep):
        cell = joined("(?:", quoted, "[^", sep, r"\r\n]*+|[^", sep, r"\r\n]*+)")
        lines = F.filter(find(text, joined(cell, "(?:[", sep, "]", cell, ")*+"), 0), lambda r: r != "")
        in_row = joined("[", sep, "]((?:", quoted, ")?+[^", sep, "]*+)")
        return F.transform(lines, lambda r: F.transform(find(F.concat(sep, r), in_row, 1), cell_text))
    return bind(separator, rows)


def parse_csv(uploads: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """CSV documents (doc_id, text, and columns to carry along) -> doc_id, the carried, headers, rows (array of cell arrays)."""
    text = F.regexp_replace(F.col("text"), BOM, "")
    grid = uploads.select("doc_id", *carry, csv_rows(text, sniff_separator(text)).alias("grid"))
    return grid.select(
        "doc_id", *carry, F.coalesce(F.get("grid", F.lit(0)), F.array().cast("array<string>")).alias("headers"),
        F.slice("grid", F.lit(2), F.greatest(F.size("grid") - 1, F.lit(0))).alias("rows"))


def named_cells(headers: Column, row: Column) -> Column:
    """array<struct(name, value)> of a row's cells. A short row has NULL cells; surplus cells stand together under `null`."""
    def cells(values):
        named = F.transform(headers, lambda h, i: F.struct(h.alias("name"), F.get(values, i).alias("value")))
        surplus = F.array(F.struct(F.lit("null").alias("name"), F.concat(
            F.lit("['"), F.array_join(F.slice(values, F.size(headers) + 1, F.size(values)), "', '"), F.lit("']")).alias("value")))
        return F.when(F.size(values) > F.size(headers), F.concat(named, surplus)).otherwise(named)
    return bind(row, cells)


def csv_records(parsed: DataFrame) -> DataFrame:
    """One row per CSV record: doc_id, record (0-based), cells array<struct(name, value)>."""
    exploded = parsed.select("doc_id", "headers", F.posexplode("rows").alias("record", "row"))
    return exploded.select("doc_id", "record", named_cells(F.col("headers"), F.col("row")).alias("cells"))


def csv_profile(records: DataFrame, preview_rows: int = 10) -> DataFrame:
    """Readable profile of each record set: size line, columns, first rows, omitted line.

    ``records``: doc_id, record, cells. Only the first rows of a document ever meet in one task
    (the row_number limit is applied before the shuffle too).
    """
    from pyspark.sql import Window
    sizes = records.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min_by(F.transform("cells", lambda c: c["name"]), F.col("record")).alias("columns"))
    first = (records.withColumn("_rn", F.row_number().over(
                Window.partitionBy("doc_id").orderBy("record")))
             .filter(F.col("_rn") <= preview_rows))
    pair = lambda c: F.concat(c["name"], F.lit(": "), F.coalesce(c["value"], F.lit("None")))
    lines = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        "_rn", F.concat(F.lit("Preview row "), F.col("_rn").cast("string"), F.lit(": "),
                        F.array_join(F.transform("cells", pair), "; ")).alias("line")))).alias("p"))
    number = lambda c: F.col(c).cast("string")
    text = F.array_join(F.array_compact(F.array(
        F.concat(F.lit("CSV document with "), number("n_rows"), F.lit(" rows and "),
                 F.size("columns").cast("string"), F.lit(" columns.")),
        F.when(F.size("columns") > 0, F.concat(F.lit("Columns: "), F.array_join("columns", ", "))),
        F.when(F.size("p") > 0, F.array_join(F.transform("p", lambda x: x["line"]), "\n")),
        F.when(F.col("n_rows") > preview_rows, F.concat(
            F.lit("... "), (F.col("n_rows") - preview_rows).cast("string"),
            F.lit(" additional rows omitted from preview."))))), "\n")
    return sizes.join(lines, "doc_id").select("doc_id", "n_rows", text.alias("profile_text"))


# --- JSON ------------------------------------------------------------------------------------

def json_shape(value: Column) -> Column:
    """'object', 'array', or the scalar kind str / int / float / bool / NoneType."""
    kind = F.schema_of_variant(value)
    return (F.when(F.startswith(kind, F.lit("OBJECT")), "object")
            .when(F.startswith(kind, F.lit("ARRAY")), "array")
            .when(kind == "STRING", "str").when(kind == "BOOLEAN", "bool")
            .when(kind == "BIGINT", "int").when(kind == "VOID", "NoneType")
            .when(kind.isNotNull(), "float"))


def strict_json(text: Column) -> Column:
    """The text as VARIANT; NULL when it is not exactly one JSON value.

    Spark's parser stops after the first value, so the text is parsed as the first item of a
    two-item array whose second item is a known mark: anything left over breaks the array.
    """
    end = "~end of value~"
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{end}"]')))
    return bind(both, lambda v: F.when(
        F.try_variant_get(v, "$[1]", "string") == end, F.try_variant_get(v, "$[0]", "variant")))


def parse_json(uploads: DataFrame) -> DataFrame:
    """JSON documents (doc_id, text) -> shape, raw_text, parser_type, preview; bad ones get reject_reason. One parse a document."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, JSON_SLICE):
                part = batch.slice(start, JSON_SLICE)
                values = [json_tree.parse(text) for text in part.column("text").to_pylist()]
                bad = [v is json_tree.INVALID for v in values]
                shown = ([None if b else of(v) for v, b in zip(values, bad, strict=True)] for of in (json_tree.shape, json_tree.readable))
                yield pa.RecordBatch.from_arrays([*part.columns, *map(utf8, shown)], [*part.schema.names, "shape", "raw_text"])

    rows = uploads.mapInArrow(read, StructType([*uploads.schema, StructField("shape", StringType()), StructField("raw_text", StringType())]))
    return (rows.withColumn("parser_type", F.lit("json")).withColumn("preview", F.left("raw_text", F.lit(500)))
            .withColumn("reject_reason", F.when(F.col("shape").isNull(), K.INVALID_JSON_REASON)))


def utf8(values: list) -> pa.Array:
    """Texts for Arrow; halves of surrogate pairs, which JSON can name, become the replacement character."""
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([v if v is None else v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for v in values], pa.string())


# --- pages -----------------------------------------------------------------------------------

def assemble_pages(pages: DataFrame) -> DataFrame:
    """Page rows (doc_id, page_no, text) -> one text per document, blank pages dropped."""
    part = F.struct("page_no", F.concat(F.lit("--- Page "), F.col("page_no").cast("string"),
                                        F.lit(" ---\n"), strip(F.col("text"))).alias("text"))
    return (pages.filter(~is_blank(F.col("text")))
            .groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("_p"))
            .select("doc_id", strip(F.array_join(
                F.transform("_p", lambda p: p["text"]), "\n\n")).alias("raw_text"),
                F.lit("pdf_text").alias("parser_type")))


def pages_without_text(pages: DataFrame) -> DataFrame:
    """Documents none of whose pages holds text."""
    return (pages.groupBy("doc_id").agg(F.bool_and(is_blank(F.col("text"))).alias("_empty"))
            .filter("_empty").select("doc_id", F.lit(K.NO_PAGE_TEXT_REASON).alias("reject_reason")))


# --- documents -------------------------------------------------------------------------------

def split_empty(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with text, refused documents with a reason)."""
    blank = is_blank(F.col("raw_text"))
    return docs.filter(~blank), docs.filter(blank).withColumn("reject_reason", F.lit(K.EMPTY_REASON))


def build_documents(parsed: DataFrame, template_keys: list[str] | None = None) -> DataFrame:
    """Content hash, size, first status and extraction mode.

    ``content`` (bytes) is hashed where present, else the text. ``requested`` is empty / auto,
    discovery, or a template key.
    """
    has_bytes = "content" in parsed.columns
    bytes_ = F.coalesce(F.col("content"), F.encode("raw_text", "UTF-8")) if has_bytes else \
        F.encode("raw_text", "UTF-8")
    asked = F.coalesce(F.nullif(F.col("requested"), F.lit("")), F.lit("auto"))
    return (parsed
            .withColumn("content_hash", F.sha2(bytes_, 256))
            .withColumn("size", F.octet_length(bytes_))
            .withColumn("status", F.lit(K.PENDING))
            .withColumn("extraction_mode", F.when(asked == "discovery", K.DISCOVERY)
                        .when(asked == "auto", K.AUTO_DETECT).otherwise(K.TEMPLATE))
            .withColumn("document_type_key", F.when(~asked.isin("discovery", "auto"), asked)))


def content_duplicates(docs: DataFrame) -> DataFrame:
    """Per content hash held by several documents: the first document and the copies."""
    return (docs.groupBy("content_hash")
            .agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc_id"))
            .filter("copies > 1"))


def original_preview(docs: DataFrame) -> DataFrame:
    """Bytes of text-like documents as text, else the parsed text."""
    mime = F.lower(F.split_part(F.coalesce(F.col("content_type"), F.lit("")), F.lit(";"), F.lit(1)))
    readable = (F.col("parser_type").isin(K.PREVIEWABLE_PARSERS) | F.startswith(mime, F.lit("text/"))
                | mime.isin(K.PREVIEWABLE_TYPES))
    return docs.withColumn("original_preview", F.when(
        readable & (F.octet_length("content") > 0), decode(F.col("content"), drop_bom=True)
    ).otherwise(F.col("raw_text")))
