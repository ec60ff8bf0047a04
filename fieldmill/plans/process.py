"""Documents in, decided fields out.

Free text never leaves its partition: template choice, labelled values, generic tokens, template
contract, validation and decision are one narrow stage over arrays no longer than the template.
Structured documents can be of any length and take the row-wise operators instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldmill import constants as K
from fieldmill.catalogue import Catalogue
from fieldmill.functions import review as R
from fieldmill.functions.common import bind, is_blank, normalize_key
from fieldmill.functions.text import generic_fields, labelled_fields, with_template
from fieldmill.functions.validation import validate
from fieldmill.operators import ingest, records
from fieldmill.operators.review import decide, validate_fields
from fieldmill.operators.templates import (
    apply_template, name_candidates, order_columns, resolve_template, strategy)
from fieldmill.schemas import FIELD, field

EMPTY = f"array<{FIELD}>"


def enforce(fields: Column, template_key: Column, template_name: Column, template_fields: Column,
            synonyms: Column) -> Column:
    """The template contract on one document's field array (free text: no record prefixes)."""
    def tag(f, i):
        order = F.array_min(F.transform(name_candidates(f["field_name"]),
                                        lambda c: F.try_element_at(synonyms, c)))
        return F.struct(f.alias("f"), i.alias("i"), order.alias("order"))

    def absent(t):
        reason = F.concat(F.lit('Required field from template "'), template_name,
                          F.lit('" was missing and must be reviewed manually.'))
        row = with_template(field(t["key"], "", 0.0, K.MISSING_SNIPPET, reason), t, template_key)
        return row.withField("rules", F.lit(None))

    def official(t, tagged):
        hits = F.transform(F.filter(tagged, lambda x: x["order"] == t["order"]), lambda x: F.struct(
            x["f"]["confidence"].alias("c"), (-x["i"]).alias("back"), x["f"].alias("f")))
        return bind(F.array_max(hits), lambda best: F.when(
            best.isNotNull(), with_template(best["f"], t, template_key, t["key"]).cast(FIELD)).when(t["required"], absent(t).cast(FIELD)))

    def suggestion(x):
        safe = F.coalesce(F.nullif(normalize_key(x["f"]["field_name"]), F.lit("")), F.lit("unknown_field"))
        return (x["f"].withField("field_name", F.concat(F.lit(K.SUGGESTED), safe))
                .withField("data_type", F.lit("suggestion")).withField("auto_accept", F.lit(True))
                .cast(FIELD))

    def contract(tagged):
        rows = F.filter(F.transform(template_fields, lambda t: official(t, tagged)),
                        lambda f: f.isNotNull())
        extras = F.transform(F.filter(tagged, lambda x: x["order"].isNull()), suggestion)
        return F.concat(rows, extras)

    return F.when(template_fields.isNull(), fields).otherwise(
        bind(F.transform(fields, tag), contract)).cast(EMPTY)


def decided(fields: Column, threshold: float = K.DEFAULT_THRESHOLD) -> Column:
    """The array with position, validation result and decision added to every field."""
    def one(f, pos):
        check = validate(F.coalesce(f["standard_field_key"], f["field_name"]), f["value"],
                         f["data_type"], f["required"], f["rules"])

        def row(v):
            review = R.needs_review(v["requires_review"], f["confidence"], f["auto_accept"], threshold)
            ok = f["auto_accept"] & ~review
            return F.struct(
                pos.alias("pos"), *[f[c].alias(c) for c in (
                    "field_name", "value", "confidence", "snippet", "reasoning", "auto_accept",
                    "standard_field_key", "template_key", "data_type", "required", "source")],
                v["status"].alias("validation_status"), v["message"].alias("validation_message"),
                v["rule"].alias("validation_rule"), review.alias("needs_review"), ok.alias("accepted"),
                F.when(ok, "system").alias("accepted_by"))
        return bind(check, row)
    return F.transform(fields, one)


def process_text(docs: DataFrame, catalogue: Catalogue, threshold: float = K.DEFAULT_THRESHOLD) -> DataFrame:
    """Free-text documents -> one row each with strategy, status, counts and the field array.

    ``docs``: doc_id, raw_text, parser_type, extraction_mode, document_type_key; other columns
    (not the text) are carried along.
    """
    carried = [c for c in docs.columns if c not in ("raw_text", "document_type_key")]
    profile = catalogue.profiles(docs.sparkSession)
    d = resolve_template(docs, catalogue).join(F.broadcast(profile), "template_key", "left")
    text = F.col("raw_text")

    def gather(labelled):
        have = F.transform(F.filter(labelled, lambda f: f["required"] & ~is_blank(f["value"])),
                           lambda f: f["standard_field_key"])
        complete = F.coalesce((F.size("required_keys") > 0)
                              & (F.size(F.array_except("required_keys", have)) == 0), F.lit(False))
        return bind(complete, lambda done: F.struct(
            F.when(done, labelled).otherwise(F.concat(labelled, generic_fields(
                text, F.col("parser_type"), F.col("low_text")))).alias("rows"),
            done.alias("complete"), (F.size(labelled) > 0).alias("has_labelled")))

    found = bind(labelled_fields(text, F.col("template_key"), F.col("labels"),
                                 F.col("template_fields")), gather)
    no = F.lit(False)
    none = F.lit(None).cast("string")

    def finish(g):
        rows = decided(enforce(g["rows"], F.col("template_key"), F.col("template_name"),
                               F.col("template_fields"), F.col("synonyms")), threshold)
        return bind(rows, lambda r: F.struct(
            r.alias("fields"),
            strategy(g["complete"], g["has_labelled"], no, no, no, none, none, none,
                     F.when(F.col("template_fields").isNotNull(), F.col("template_key"))).alias("strategy"),
            F.when(F.exists(r, lambda f: f["needs_review"]), K.NEEDS_REVIEW).otherwise(K.APPROVED)
            .alias("status"),
            F.size(F.filter(r, lambda f: f["accepted"])).alias("accepted_fields"),
            F.size(F.filter(r, lambda f: ~f["accepted"])).alias("review_fields")))

    applied = F.when(F.col("template_fields").isNotNull(), F.col("template_key"))
    out = d.select(*carried, applied.alias("applied_template"),
                   F.col("template_name").alias("document_type_label"), bind(found, finish).alias("_r"))
    return out.select(*carried, "applied_template", "document_type_label", "_r.*")


def field_rows(processed: DataFrame) -> DataFrame:
    """One row per field of processed documents.

    The outer form, as Spark puts a filter on a non-empty array before the other one, and so works out all fields again for it.
    """
    return processed.select("doc_id", F.inline_outer("fields")).where("pos is not null")


def structured_rows(docs: DataFrame, max_depth: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Raw field rows of CSV and JSON documents (doc_id, text, parser_type), pos as written; no shuffle, one parse a document.

    Every row of a document has its columns in ``carry``. A JSON text that is refused has one row without field_name.
    """
    csv = records.csv_fields(ingest.parse_csv(docs.filter("parser_type = 'csv'"), carry))
    return csv.unionByName(records.json_fields(docs.filter("parser_type = 'json'"), max_depth, carry=carry).drop("shape", "is_head"))


def structured_fields(docs: DataFrame, catalogue: Catalogue, threshold: float = K.DEFAULT_THRESHOLD,
                      max_depth: int | None = None) -> DataFrame:
    """CSV and JSON documents (doc_id, text, parser_type, document_type_key) as decided field rows, refused ones as a row without field_name.

    A template applies only where the document names one that exists; only the rows of such documents are shuffled. Ties between two
    aliases of one field go to the one written first. Adds doc_template and the sort columns of template order (ORDER_BY).
    """
    known = F.col("document_type_key").isin([t.key for t in catalogue.templates])
    free = docs.where(F.coalesce(~known, F.lit(True)))
    # the rows bring their document's template along and never look for it; a refused document has none
    ruled = structured_rows(docs.where(known).withColumn("doc_template", F.col("document_type_key")), max_depth, ("doc_template",))
    ruled = ruled.where("field_name is null or doc_id is not null").withColumn(
        "doc_template", F.when(F.col("field_name").isNotNull(), F.col("doc_template")))
    rows = structured_rows(free, max_depth).withColumn("doc_template", F.lit(None).cast("string"))
    rows = rows.unionByName(apply_template(ruled, catalogue))
    return order_columns(decide(validate_fields(rows), threshold), catalogue)


def process_structured(docs: DataFrame, catalogue: Catalogue, threshold: float = K.DEFAULT_THRESHOLD,
                       max_depth: int | None = None) -> DataFrame:
    """The decided field rows of structured_fields, without the refused documents."""
    return structured_fields(docs, catalogue, threshold, max_depth).where("field_name is not null")


def structured_documents(fields: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Rows of structured_fields -> one row per document: strategy, applied_template, document_type_label, extraction_mode, status,
    accepted_fields, review_fields, reject_reason. Refused documents have a reason and nothing else."""
    there = F.col("field_name").isNotNull()
    one = fields.groupBy("doc_id").agg(
        F.count_if(there).alias("_n"), F.bool_or(there & F.col("needs_review")).alias("_review"), F.max("doc_template").alias("applied_template"),
        F.count_if(there & F.col("accepted")).alias("accepted_fields"), F.count_if(there & ~F.col("accepted")).alias("review_fields"))
    good, template = F.col("_n") > 0, F.col("applied_template")
    no, none = F.lit(False), F.lit(None).cast("string")
    return one.select(
        "doc_id", F.when(good, strategy(no, no, no, no, no, none, none, none, template)).alias("strategy"), "applied_template",
        catalogue.label_of(template).alias("document_type_label"),
        F.when(good, F.when(F.col("_review"), K.NEEDS_REVIEW).otherwise(K.APPROVED)).alias("status"),
        F.when(good, F.col("accepted_fields")).alias("accepted_fields"), F.when(good, F.col("review_fields")).alias("review_fields"),
        F.when(~good, K.INVALID_JSON_REASON).alias("reject_reason"))
