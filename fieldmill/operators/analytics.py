"""Search, dashboard and record queries over documents, fields and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, DateType, StringType, TimestampNTZType, TimestampType

from fieldmill import constants as K
from fieldmill.functions import labels as L
from fieldmill.functions.review import blocks_approval
from fieldmill.llm.common import stored
from fieldmill.operators.review import mean, mean_units
from fieldmill.operators.skew import row_index

SEARCHED = ["filename", "content_type", "parser_type", "document_type_key", "document_type_label",
            "raw_text", "error_message"]


def _like(column: str, text: str) -> Column:
    return F.ilike(F.col(column), F.lit(f"%{text}%"))


def _any(conditions: list[Column]) -> Column:
    hit = F.lit(False)
    for c in conditions:
        hit = hit | F.coalesce(c, F.lit(False))
    return hit


# --- search ----------------------------------------------------------------------------------

def search_documents(docs: DataFrame, status: str | None = None, q: str | None = None,
                     limit: int = 100, columns: list[str] = SEARCHED) -> DataFrame:
    """Newest documents with a status whose searched columns hold the text (any case)."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    if status and status != "all":
        docs = docs.filter(F.col("status") == status)
    if q and q.strip():
        docs = docs.filter(_any([_like(c, q.strip()) for c in columns if c in docs.columns]))
    return docs.orderBy(F.desc("created_at"), F.desc("doc_id")).limit(limit)


def search_table(df: DataFrame, id_column: str, q: str | None = None, limit: int = 100,
                 offset: int = 0, after: int | None = None) -> DataFrame:
    """Rows of any table with the text in any string column, newest id first, one page.

    ``after``: the last id of the page before. The filter on it reaches the scan, so a page costs what follows the one before and
    never what was shown already; ``offset`` reads and sorts all that it skips and is there for the first few pages.
    """
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be between 1 and 500, offset at least 0")
    if q and q.strip():
        names = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
        if names:
            df = df.filter(_any([_like(c, q.strip()) for c in names]))
    if after is not None:
        df = df.filter(F.col(id_column) < after)
    return df.orderBy(F.desc(id_column)).offset(offset).limit(limit)


def printable(df: DataFrame) -> DataFrame:
    """Bytes as `<n bytes>`, times as ISO text; driven by the schema."""
    def shown(f):
        c = F.col(f.name)
        if isinstance(f.dataType, BinaryType):
            return F.concat(F.lit("<"), F.octet_length(c).cast("string"), F.lit(" bytes>"))
        if isinstance(f.dataType, DateType):
            return c.cast("string")
        if isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            zone = "+00:00" if isinstance(f.dataType, TimestampType) else ""
            whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            micros = F.date_format(c, "SSSSSS")
            return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros))
                            .otherwise(""), F.lit(zone))
        return c
    return df.select(*[shown(f).alias(f.name) for f in df.schema])


def table_catalogue(spark, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, position, column_name) of the given tables; reads schemas only."""
    rows = [(name, i, c) for name, df in tables.items() for i, c in enumerate(df.columns)]
    array = F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(i).alias("position"),
                               F.lit(c).alias("column_name")) for t, i, c in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(array))


def concat_search(docs: DataFrame, q: str = "", status: str = "all") -> DataFrame:
    """Status filter plus substring over name, type, parser and text written as one line."""
    if status != "all":
        docs = docs.filter(F.col("status") == status)
    if q.strip():
        line = F.concat_ws(" ", L.file_label(F.col("filename"), F.col("doc_id")),
                           F.coalesce("content_type", F.lit("")), F.col("parser_type"), F.col("raw_text"))
        docs = docs.filter(F.contains(F.lower(line), F.lit(q.strip().lower())))
    return docs


# --- one document ----------------------------------------------------------------------------

def document_view(documents: DataFrame, fields: DataFrame, corrections: DataFrame, jobs: DataFrame,
                  briefings: DataFrame, page_size: int = 1_000) -> DataFrame:
    """Documents with nested, ordered fields (with nested corrections), jobs and briefings.

    Nested lists are paged: ``page`` 0 holds the first ``page_size`` children of each kind, and a
    document with more children comes as several rows, so no list outgrows a task. Nothing is cut.
    Only children of documents with more than one page are ranked; all others are dealt out once, by document.
    """
    def paged(df, keys, order, kind):
        first = order[0] if isinstance(order, list) else order
        return row_index(df, keys, F.floor(F.col(first) / 100_000), order if isinstance(order, list) else [order], f"_{kind}_pos").withColumn(
            "page", F.floor(F.col(f"_{kind}_pos") / page_size)).drop(f"_{kind}_pos")

    def nested(df, keys, order, item, name):
        # dealt out as rows: lists begun before the shuffle would be sorted, and spilled, there, and drop nothing
        return df.repartition(*keys, "page").groupBy(*keys, "page").agg(F.transform(F.array_sort(F.collect_list(F.struct(
            order.alias("_o"), item.alias("item")))), lambda x: x["item"]).alias(name))

    def sizes(df):
        return df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))

    def by_document(df, order, kind):
        """Every child with its page. A child without a document meets none."""
        # at most one in ``page_size`` rows is a key here
        hot = F.broadcast(sizes(df).where(F.col("_n") > page_size).select("doc_id"))
        few = df.join(hot, "doc_id", "left_anti").withColumn("page", F.lit(0).cast("bigint"))
        return few.unionByName(paged(df.join(hot, "doc_id", "left_semi"), ["doc_id"], order, kind))

    owned = lambda df, *names: df.where("doc_id is not null").select("doc_id", *names)
    # written first, so that its real size decides: where few fields were corrected, no field is shuffled for it
    history = stored(nested(paged(corrections, ["field_id"], "correction_id", "c"), ["field_id"], F.col("correction_id"),
                            F.struct("correction_id", "old_value", "corrected_value", "corrected_by"), "corrections"), "histories")
    corrected = stored(history.select("field_id").distinct(), "corrected-fields")
    shown = owned(fields, "field_id", "field_name", "extracted_value", "confidence", "accepted", "needs_review")
    rows = shown.join(corrected, "field_id", "left_semi").join(history, "field_id").withColumnRenamed("page", "_correction_page")
    plain = shown.join(corrected, "field_id", "left_anti")
    rows = rows.unionByName(plain.withColumn("_correction_page", F.lit(0).cast("bigint")), allowMissingColumns=True)
    jobs, briefings = owned(jobs, "job_id", "status", "attempts"), owned(briefings, "briefing_id", "summary")
    last = [sizes(x).select("doc_id", F.floor((F.col("_n") - 1) / page_size).alias("_last")) for x in (rows, jobs, briefings)]
    last = last[0].unionByName(last[1]).unionByName(last[2]).groupBy("doc_id").agg(F.max("_last").alias("_last"))
    field_pages = nested(by_document(rows, ["field_id", "_correction_page"], "f"), ["doc_id"], F.struct("field_id", "_correction_page"), F.struct(
        "field_id", "field_name", "extracted_value", "confidence", "accepted", "needs_review",
        "corrections"), "fields")
    job_pages = nested(by_document(jobs, "job_id", "j"), ["doc_id"], F.col("job_id"),
                       F.struct("job_id", "status", "attempts"), "jobs")
    briefing_pages = nested(by_document(briefings, "briefing_id", "b"), ["doc_id"], F.col("briefing_id"),
                            F.struct("briefing_id", "summary"), "briefings")
    # the pages of each document are known beforehand, so that the lists meet them where they were gathered, by document and page
    pages = documents.join(last.hint("merge"), "doc_id", "left").withColumn(
        "page", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_last", F.lit(0).cast("bigint"))))).drop("_last")
    for lists in (field_pages, job_pages, briefing_pages):
        pages = pages.join(lists.hint("merge"), ["doc_id", "page"], "left")
    return pages.select("doc_id", *[c for c in documents.columns if c != "doc_id"], "page", "fields", "jobs", "briefings")


def audit_trail(audit: DataFrame, doc_id: int | None = None, newest_first: bool = False) -> DataFrame:
    """Audit rows of one document (or all, by document) in time order."""
    if doc_id is not None:
        audit = audit.filter(F.col("doc_id") == doc_id)
    way = F.desc if newest_first else F.asc
    return audit.orderBy("doc_id", way("created_at"), way("event_id"))


def latest_action(documents: DataFrame, audit: DataFrame) -> DataFrame:
    """Adds the newest action, actor and time per document; a missing time counts as the document's."""
    joined = audit.join(documents.select("doc_id", F.col("created_at").alias("_doc_at")), "doc_id")
    last = joined.groupBy("doc_id").agg(F.max_by(
        F.struct("action", "actor", "created_at"),
        F.struct(F.coalesce("created_at", "_doc_at"), "event_id")).alias("_l"))
    return documents.join(last, "doc_id", "left").select(
        *[documents[c] for c in documents.columns], F.col("_l.action").alias("latest_action"),
        F.col("_l.actor").alias("latest_actor"), F.col("_l.created_at").alias("latest_at"))


# --- dashboard -------------------------------------------------------------------------------

def status_counts(documents: DataFrame) -> DataFrame:
    """Documents per status; the known statuses are always listed."""
    counts = documents.groupBy("status").agg(F.count(F.lit(1)).alias("documents"))
    known = documents.sparkSession.range(0, 1, 1, 1).select(
        F.explode(F.array(*[F.lit(s) for s in K.DOCUMENT_STATUSES])).alias("status"))
    return known.join(counts, "status", "full_outer").select(
        "status", F.coalesce("documents", F.lit(0)).alias("documents"))


def parser_counts(documents: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif("parser_type", F.lit("")), F.lit("unknown"))
    return (documents.groupBy(name.alias("parser_type")).agg(F.count(F.lit(1)).alias("documents"))
            .orderBy(F.desc("documents"), "parser_type"))


def field_metrics(fields: DataFrame, corrections: DataFrame, audit: DataFrame) -> DataFrame:
    """One row: fields, accepted, to review, corrections, manually added. One pass per table."""
    zero = F.lit(0).cast("bigint")
    names = ["total_fields", "accepted_fields", "needs_review_fields", "corrections", "manually_added"]
    def part(df, **own):
        return df.agg(*[own.get(n, F.max(zero)).alias(n) for n in names])
    one = F.count(F.lit(1))
    parts = (part(fields, total_fields=one, accepted_fields=F.count_if("accepted"),
                  needs_review_fields=F.count_if("needs_review"))
             .unionByName(part(corrections, corrections=one))
             .unionByName(part(audit, manually_added=F.count_if(F.col("action") == "field_manually_added"))))
    return parts.agg(*[F.sum(n).cast("bigint").alias(n) for n in names])


def average_confidence(scored: DataFrame) -> DataFrame:
    """Mean extraction and review confidence over all fields, 0 when there are none."""
    return scored.agg(F.coalesce(mean("confidence", 4), F.lit(0.0)).alias("avg_confidence"),
                      F.coalesce(mean("review_confidence", 4), F.lit(0.0)).alias("avg_review_confidence"))


def review_queue(documents: DataFrame, fields: DataFrame, limit: int = 5) -> DataFrame:
    """The most recently updated documents to review, with their blocking fields.

    The limit comes first; only fields of those few documents are counted.
    """
    top = (documents.filter(F.col("status") == K.NEEDS_REVIEW)
           .select("doc_id", "filename", "status", "updated_at")
           .orderBy(F.desc("updated_at"), F.desc("doc_id")).limit(limit))
    blocking = (fields.join(F.broadcast(top.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(
        F.count_if(blocks_approval(F.col("needs_review"), F.col("accepted"))).alias("blocking_fields")))
    return top.join(blocking, "doc_id", "left").select(
        "doc_id", L.file_label(F.col("filename"), F.col("doc_id")).alias("filename"), "status",
        F.coalesce("blocking_fields", F.lit(0)).alias("blocking_fields"), "updated_at")


def recent_activity(audit: DataFrame, documents: DataFrame, limit: int = 10) -> DataFrame:
    """The newest audit rows with what is known of their documents; the limit comes first."""
    top = audit.orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit)
    docs = documents.select("doc_id", "filename", "parser_type", F.col("status").alias("document_status"))
    docs = docs.join(F.broadcast(top.select("doc_id").distinct()), "doc_id", "left_semi")
    name = (F.when(F.coalesce("filename", F.lit("")) != "", F.col("filename"))
            .when(F.col("doc_id").isNotNull(), F.concat(F.lit("Document #"), F.col("doc_id").cast("string")))
            .otherwise("System"))
    return top.join(docs, "doc_id", "left").select(
        "event_id", "doc_id", name.alias("filename"), "parser_type", "document_status", "action",
        "actor", "details", "created_at")


def record_stats(documents: DataFrame) -> DataFrame:
    """One row: total and one column per status."""
    return documents.agg(F.count(F.lit(1)).alias("total"), *[
        F.count_if(F.col("status") == s).alias(s) for s in K.DOCUMENT_STATUSES])


def record_list(documents: DataFrame, scored: DataFrame) -> DataFrame:
    """Per document: number of fields and average review confidence in percent."""
    per = scored.groupBy("doc_id").agg(F.count(F.lit(1)).alias("fields"),
                                       mean_units("review_confidence", 2).alias("review_percent"))
    return documents.join(per, "doc_id", "left").select(
        "doc_id", "status", F.coalesce("fields", F.lit(0)).alias("fields"), "review_percent")


def client_stats(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """One row of counts; a document also needs review when any of its fields does."""
    open_ = fields.filter("needs_review").select("doc_id").distinct().withColumn("_open", F.lit(True))
    d = documents.select("doc_id", "status").join(open_, "doc_id", "left")
    is_ = lambda s: F.col("status") == s
    return d.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_(K.APPROVED)).alias("approved"),
        F.count_if(is_(K.NEEDS_REVIEW) | F.coalesce("_open", F.lit(False))).alias("needs_review"),
        F.count_if(is_(K.PENDING)).alias("pending"), F.count_if(is_(K.ERROR)).alias("error"),
        F.count_if(is_(K.REJECTED)).alias("rejected"))


def fields_pivot(fields: DataFrame, keys: list[str]) -> DataFrame:
    """One row per document, one column per standard key (the row of highest confidence).

    The keys are given, so no pass over the data is needed to find the columns.
    """
    pick = lambda k: F.max_by("value", F.when(
        F.col("standard_field_key") == k, F.struct("confidence", -F.col("pos")))).alias(k)
    return fields.filter(F.col("standard_field_key").isin(keys)).groupBy("doc_id").agg(*[pick(k) for k in keys])


def run_metadata(fields: DataFrame) -> DataFrame:
    """Provider and model of the first field of each document that names them."""
    why = F.col("reasoning")
    return (fields.filter(F.rlike(why, F.lit(K.RUN_METADATA))).groupBy("doc_id")
            .agg(F.min_by("reasoning", "field_id").alias("_why"))
            .select("doc_id", L.run_provider(F.col("_why")).alias("provider"),
                    L.run_model(F.col("_why")).alias("model")))
