"""Decisions on fields, document status, reviewer actions, audit rows and briefings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldmill import constants as K
from fieldmill.catalogue import Catalogue
from fieldmill.functions import review as R
from fieldmill.functions.common import is_blank, percent, strip
from fieldmill.functions.validation import check, explain, validate
from fieldmill.llm.common import stored
from fieldmill.operators.skew import asked_for, bucketed_join, day_bucket, keyed_join, previous_values
from fieldmill.operators.templates import match_fields

AUDIT_COLUMNS = ["doc_id", "action", "actor", "details"]


def mean_units(c: str, places: int) -> Column:
    """Average of a score in units of its last place, half up, as an exact integer.

    Scores are summed as millionths, so neither the row order nor the partitioning matters.
    """
    total = F.sum(F.round(F.col(c) * 1_000_000).cast("bigint"))
    unit = F.count(F.col(c)) * 10 ** (6 - places)
    top, below = 2 * total + unit, 2 * unit
    return F.when(below > 0, ((top - F.pmod(top, below)) / below).cast("bigint"))


def mean(c: str, places: int) -> Column:
    return mean_units(c, places) / 10 ** places


# --- decisions -------------------------------------------------------------------------------

def validate_fields(fields: DataFrame) -> DataFrame:
    """Adds validation_status, validation_message, validation_rule, requires_review."""
    ident = F.coalesce("standard_field_key", "field_name")
    checked = fields.withColumn("_c", check(
        F.col("value"), F.col("data_type"), F.col("required"), F.col("rules"))).withColumn(
        "_v", explain(F.col("_c"), ident))
    return checked.select(
        *fields.columns, F.col("_v.status").alias("validation_status"),
        F.col("_v.message").alias("validation_message"), F.col("_v.rule").alias("validation_rule"),
        F.col("_v.requires_review").alias("requires_review"))


def decide(validated: DataFrame, threshold: float = K.DEFAULT_THRESHOLD) -> DataFrame:
    """Adds needs_review, accepted, accepted_by."""
    return (validated
            .withColumn("needs_review", R.needs_review(
                F.col("requires_review"), F.col("confidence"), F.col("auto_accept"), threshold))
            .withColumn("accepted", F.col("auto_accept") & ~F.col("needs_review"))
            .withColumn("accepted_by", F.when(F.col("accepted"), "system")))


def document_status(decided: DataFrame) -> DataFrame:
    """Status of each document right after processing, with its two counts."""
    return decided.groupBy("doc_id").agg(
        F.when(F.bool_or("needs_review"), K.NEEDS_REVIEW).otherwise(K.APPROVED).alias("status"),
        F.count_if("accepted").alias("accepted_fields"),
        F.count_if(~F.col("accepted")).alias("review_fields"))


# --- corrections -----------------------------------------------------------------------------

def display_values(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Adds corrected (any correction?) and display_value (latest correction, else extracted).

    The latest corrections are written first, so that their real size decides: where they are few, no field is shuffled.
    """
    latest = stored(corrections.groupBy("field_id").agg(F.max_by(
        F.struct("corrected_value"), F.struct("corrected_at", "correction_id")).alias("_last")), "latest-corrections")
    return (fields.join(latest, "field_id", "left")
            .withColumn("corrected", F.col("_last").isNotNull())
            .withColumn("display_value", F.when(
                F.col("corrected"), F.col("_last.corrected_value")).otherwise(F.col("extracted_value")))
            .drop("_last"))


def review_confidence(displayed: DataFrame, method: str = "sequence") -> DataFrame:
    """Adds review_confidence in one pass. Only texts that need a comparison reach it, repeated pairs once per batch.

    method: `sequence` (Ratcliff-Obershelp, Arrow batches) or `levenshtein` (JVM only).
    """
    cheap = R.cheap_review_confidence(F.col("confidence"), F.col("extracted_value"),
                                      F.col("display_value"), F.col("corrected"))
    scored = displayed.withColumn("review_confidence", cheap)
    a, b = R.for_review(F.col("extracted_value")), R.for_review(F.col("display_value"))
    if method == "levenshtein":
        return scored.withColumn("review_confidence", F.coalesce("review_confidence", R.edit_ratio(a, b)))
    return scored.withColumn("review_confidence", F.coalesce(
        cheap, R.sequence_ratio(F.when(cheap.isNull(), a), F.when(cheap.isNull(), b))))


def review_statuses(scored: DataFrame) -> DataFrame:
    return scored.withColumn("review_status", R.review_status(
        F.col("accepted"), F.col("needs_review"), F.col("corrected"), F.col("review_confidence")))


# --- refresh ---------------------------------------------------------------------------------

def auto_accept_exact(displayed: DataFrame, threshold: float = K.DEFAULT_THRESHOLD) -> DataFrame:
    """Unaccepted fields shown as extracted become accepted; doubtful ones are flagged.

    Adds auto_accepted and rewrites accepted, needs_review, accepted_by.
    """
    open_ = ~F.col("accepted")
    doubtful = R.low_confidence(F.col("confidence"), threshold) | R.blocked_by_validation(
        F.col("validation_status"))
    take = open_ & ~doubtful & (F.col("extracted_value") == F.col("display_value"))
    return displayed.withColumn("auto_accepted", F.coalesce(take, F.lit(False))).select(
        *[c for c in displayed.columns if c not in ("accepted", "needs_review", "accepted_by")],
        "auto_accepted",
        F.when(open_ & doubtful, True).when(F.col("auto_accepted"), False)
        .otherwise(F.col("needs_review")).alias("needs_review"),
        (F.col("accepted") | F.col("auto_accepted")).alias("accepted"),
        F.when(F.col("auto_accepted"), "system").otherwise(F.col("accepted_by")).alias("accepted_by"))


def auto_accept_audit(refreshed: DataFrame, threshold: float = K.DEFAULT_THRESHOLD,
                      named: int = 8) -> DataFrame:
    """One audit row per document with auto-accepted fields, naming the first eight."""
    taken = refreshed.filter("auto_accepted").select("doc_id", "field_id", "field_name")
    first = (taken.withColumn("_rn", F.row_number().over(
                Window.partitionBy("doc_id").orderBy("field_id"))).filter(F.col("_rn") <= named)
             .groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_rn", "field_name"))).alias("_n")))
    n = taken.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    more = F.when(F.col("n") > named, F.concat(
        F.lit(", and "), (F.col("n") - named).cast("string"), F.lit(" more"))).otherwise("")
    details = F.concat(
        F.lit("Auto-accepted "), F.col("n").cast("string"),
        F.lit(" field(s) because the original extracted value exactly matched the current "
              f"review/display value and met the {round(threshold * 100)}% confidence threshold: "),
        F.array_join(F.transform("_n", lambda x: x["field_name"]), ", "), more, F.lit("."))
    return n.join(first.hint("merge"), "doc_id").select(
        "doc_id", F.lit("fields_auto_accepted_exact_match").alias("action"),
        F.lit("system").alias("actor"), details.alias("details"))


def refresh_status(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """Adds total_fields, blocking_fields, new_status; closed or waiting documents stay as they are.

    ``fields`` have been through ``auto_accept_exact``.
    """
    counts = fields.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_fields"),
        F.count_if(R.blocks_approval(F.col("needs_review"), F.col("accepted"))).alias("blocking_fields"))
    fixed = F.col("status").isin(K.ERROR, K.PENDING, K.REJECTED)
    joined = documents.join(counts, "doc_id", "left").fillna(0, ["total_fields", "blocking_fields"])
    return joined.withColumn("new_status", F.when(fixed, F.col("status")).when(
        (F.col("total_fields") > 0) & (F.col("blocking_fields") == 0), K.APPROVED
    ).otherwise(K.NEEDS_REVIEW))


def status_audit(refreshed: DataFrame, actor: str = "system") -> DataFrame:
    """One audit row per status change, a second one when it is an approval."""
    total, blocking = F.col("total_fields").cast("string"), F.col("blocking_fields").cast("string")
    change = F.struct(
        F.lit("document_state_changed").alias("action"), F.concat(
            F.lit("Document status changed from "), F.col("status"), F.lit(" to "),
            F.col("new_status"), F.lit(". Approval requires all "), total,
            F.lit(" fields accepted and zero fields needing review; "), blocking,
            F.lit(" blocking field(s) remain.")).alias("details"))
    approval = F.when(F.col("new_status") == K.APPROVED, F.struct(
        F.lit("document_approved").alias("action"), F.concat(
            F.lit(f"Document approved by {actor}. All "), total,
            F.lit(" extracted field(s) are accepted and zero fields require review.")).alias("details")))
    changed = refreshed.filter(F.col("status") != F.col("new_status"))
    return changed.select("doc_id", F.explode(F.array_compact(F.array(change, approval))).alias("_a")).select(
        "doc_id", "_a.action", F.lit(actor).alias("actor"), "_a.details")


# --- reviewer actions ------------------------------------------------------------------------

def split_readonly(actions: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(actions that may go on, refused actions): nothing changes on a rejected document.

    ``documents``: doc_id, rejected_at (NULL where open). An action at or after that time is refused.
    """
    closed = documents.filter("rejected_at is not null").select("doc_id", "rejected_at")
    tagged = keyed_join(actions, closed, ["doc_id"], "left")
    late = F.coalesce(F.col("ts") >= F.col("rejected_at"), F.lit(False))
    refused = tagged.filter(late).drop("rejected_at").withColumn("refusal", F.lit(K.REFUSED_READONLY))
    return tagged.filter(~late).drop("rejected_at"), refused


def fold_actions(fields: DataFrame, actions: DataFrame) -> DataFrame:
    """What each correct / accept action does, in (ts, action_id) order per field.

    ``fields``: field_id, doc_id, field_name, extracted_value (as displayed so far), confidence,
    standard_field_key, data_type, required, accepted, needs_review. ``actions``: action_id, ts,
    kind, field_id, field_name, value, actor; NULL name or value means unchanged.

    Adds old_value, new_value, old_name, new_name, outcome (applied / unchanged / blocked /
    refused), refusal, new_accepted, validation_*. Values chain through earlier actions of the
    field; they are re-validated without template rules.
    """
    known = asked_for(fields, actions, ["field_id"]).select(
        "field_id", F.col("doc_id").alias("_doc"), F.col("field_name").alias("_name"), "extracted_value",
        "standard_field_key", "data_type", "required",
        (F.col("accepted") & ~F.col("needs_review")).alias("_settled"))
    # a hot field is spread by days from here on: its row goes to every day, and what happened is summed up per day
    a = bucketed_join(actions, known, ["field_id"], F.coalesce(day_bucket(F.col("ts")), F.lit(0).cast("timestamp")))
    correct = F.col("kind") == "correct"
    name = strip(F.when(correct, F.nullif(F.col("field_name"), F.lit(""))))
    locked = F.coalesce(F.col("standard_field_key"), F.lit("")) != ""
    refusal = (F.when(F.col("_doc").isNull(), K.REFUSED_NO_FIELD)
               .when(locked & (name != F.col("_name")), K.REFUSED_LOCKED)
               .when(name == "", K.REFUSED_NAME)
               .when(correct & F.col("value").isNotNull() & is_blank(F.col("value")), K.REFUSED_VALUE))
    a = a.withColumn("refusal", refusal).withColumn("_ok", F.col("refusal").isNull())
    a = (a.withColumn("_value", F.when(F.col("_ok") & correct, F.col("value")))
         .withColumn("_newname", F.when(F.col("_ok"), name))
         .withColumn("_any", F.when(F.col("_ok"), True)))
    a = previous_values(a, ["field_id"], day_bucket(F.col("ts")), ["ts", "action_id"],
                        ["_value", "_newname", "_any"])
    a = (a.withColumn("old_value", F.coalesce("prev__value", "extracted_value"))
         .withColumn("old_name", F.coalesce("prev__newname", "_name"))
         .withColumn("new_value", F.coalesce("_value", "old_value"))
         .withColumn("new_name", F.when(locked, F.col("old_name")).otherwise(
             F.coalesce("_newname", "old_name")))
         .withColumn("refusal", F.coalesce("refusal", F.when(
             correct & is_blank(F.col("new_value")), K.REFUSED_VALUE))))
    ident = F.coalesce(F.nullif(F.col("standard_field_key"), F.lit("")), F.col("new_name"))
    result = lambda v: validate(ident, v, F.col("data_type"), F.col("required"))
    a = a.withColumn("_v", result(F.col("new_value"))).withColumn("_o", result(F.col("old_value")))
    settled = F.when(F.coalesce("prev__any", F.lit(False)) & ~is_blank(F.col("old_value")),
                     ~F.col("_o.requires_review")).otherwise(F.col("_settled"))
    same = (F.col("new_value") == F.col("old_value")) & (F.col("new_name") == F.col("old_name"))
    outcome = (F.when(F.col("refusal").isNotNull(), "refused")
               .when(correct & same & settled, "unchanged")
               .when(~correct & F.col("_v.requires_review"), "blocked")
               .otherwise("applied"))
    return a.withColumn("outcome", outcome).select(
        "action_id", "ts", "kind", F.col("_doc").alias("doc_id"), "field_id", "actor", "outcome",
        "refusal", "old_name", "new_name", "old_value", "new_value",
        F.col("_v.status").alias("validation_status"), F.col("_v.message").alias("validation_message"),
        F.col("_v.rule").alias("validation_rule"),
        (~F.col("_v.requires_review")).alias("new_accepted"))


def new_corrections(folded: DataFrame) -> DataFrame:
    """The correction history rows the applied value changes add."""
    return folded.filter("outcome = 'applied' and kind = 'correct' and new_value <> old_value").select(
        F.col("action_id").alias("correction_id"), "field_id", "old_value",
        F.col("new_value").alias("corrected_value"), F.col("actor").alias("corrected_by"),
        F.col("ts").alias("corrected_at"))


def field_states(folded: DataFrame) -> DataFrame:
    """State of each touched field after its last effective action."""
    done = folded.filter("outcome in ('applied', 'blocked')")
    last = F.max_by(F.struct("new_name", "new_value", "new_accepted", "validation_status",
                             "actor", "ts"), F.struct("ts", "action_id"))
    return done.groupBy("field_id").agg(last.alias("_s")).select(
        "field_id", F.col("_s.new_name").alias("field_name"),
        F.col("_s.new_value").alias("display_value"), F.col("_s.new_accepted").alias("accepted"),
        (~F.col("_s.new_accepted")).alias("needs_review"), "_s.validation_status",
        F.when(F.col("_s.new_accepted"), F.col("_s.actor")).alias("accepted_by"))


def fold_audit(folded: DataFrame) -> DataFrame:
    """Audit rows of corrections and accepts."""
    q = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    renamed = F.col("new_name") != F.col("old_name")
    changed = F.col("new_value") != F.col("old_value")
    correct = F.col("kind") == "correct"
    names = F.concat(q("old_name"), F.lit(" to "), q("new_name"))
    parts = F.array_compact(F.array(
        F.when(renamed, F.concat(F.lit("field name changed from "), names)),
        F.when(changed, F.concat(F.lit("display value changed from "), q("old_value"),
                                 F.lit(" to "), q("new_value")))))
    said = F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise(
        F.concat(F.lit("field "), q("new_name"), F.lit(" accepted without changes")))
    row = lambda action, details: F.struct(F.lit(action).alias("action"), details.alias("details"))
    rows = F.array_compact(F.array(
        F.when(correct & renamed, row("field_name_changed", F.concat(
            F.lit("Extraction field name changed from "), names, F.lit(".")))),
        F.when(correct, row("field_reviewed", F.concat("new_name", F.lit(": "), said, F.lit(".")))),
        F.when(F.col("outcome") == "blocked", row("field_acceptance_blocked_by_validation", F.concat(
            "new_name", F.lit(": cannot be accepted because validation failed: "), "validation_message"))),
        F.when(~correct, row("field_accepted", F.concat(
            "new_name", F.lit(": accepted display value "), q("new_value"), F.lit("."))))))
    return (folded.filter("outcome in ('applied', 'blocked')")
            .select("doc_id", "actor", F.explode(rows).alias("_a"))
            .select("doc_id", "_a.action", "actor", "_a.details"))


def apply_additions(actions: DataFrame, documents: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Reviewer-added fields: action_id, outcome, refusal and the new field's columns.

    ``documents``: doc_id, status, document_type_key.
    """
    docs = documents.select("doc_id", "status", F.col("document_type_key").alias("doc_template"))
    a = keyed_join(actions.withColumnRenamed("field_name", "_given"), docs, ["doc_id"])
    a = a.withColumn("field_name", strip(F.coalesce("_given", F.lit("")))).withColumn(
        "value", strip(F.coalesce("value", F.lit(""))))
    a = match_fields(a, catalogue)
    has, m = F.col("template_name").isNotNull() | F.col("doc_template").isNotNull(), F.col("match")
    stored = F.when(m.isNotNull(), m["key"]).when(has, F.concat(
        F.lit(K.SUGGESTED), F.replace(F.lower("field_name"), F.lit(" "), F.lit("_")))
    ).otherwise(F.col("field_name"))
    data_type = F.when(m.isNotNull(), m["data_type"]).when(has, "suggestion")
    a = a.withColumn("_v", validate(stored, F.col("value"), data_type,
                                    F.coalesce(m["required"], F.lit(False)), m["rules"]))
    refusal = (F.when(F.col("status").isNull(), K.REFUSED_NO_DOCUMENT)
               .when(F.col("status") == K.REJECTED, K.REFUSED_READONLY)
               .when(F.col("field_name") == "", K.REFUSED_ADD_NAME)
               .when(F.col("value") == "", K.REFUSED_ADD_VALUE))
    ok = ~F.col("_v.requires_review")
    return a.withColumn("refusal", refusal).select(
        "action_id", "doc_id", "actor",
        F.when(F.col("refusal").isNull(), "added").otherwise("refused").alias("outcome"), "refusal",
        stored.alias("field_name"), m["key"].alias("standard_field_key"),
        F.when(m.isNotNull(), F.col("doc_template")).alias("template_key"), data_type.alias("data_type"),
        F.coalesce(m["required"], F.lit(False)).alias("required"),
        F.col("value").alias("extracted_value"), F.lit(1.0).alias("confidence"),
        F.left(F.coalesce(F.nullif(F.col("source_snippet"), F.lit("")), F.lit(K.MANUAL_SNIPPET)),
               F.lit(500)).alias("snippet"),
        F.lit(K.MANUAL_REASON).alias("reasoning"), F.col("_v.status").alias("validation_status"),
        (~ok).alias("needs_review"), ok.alias("accepted"),
        F.when(ok, F.col("actor")).alias("accepted_by"))


def removable(fields: DataFrame) -> Column:
    return (F.startswith("field_name", F.lit(K.SUGGESTED))
            | F.contains(F.coalesce("reasoning", F.lit("")), F.lit(K.MANUAL_MARK))
            | (F.coalesce("data_type", F.lit("")) == "suggestion"))


def apply_removals(fields: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining fields, one outcome per action). Only suggested or manual fields can go."""
    status = stored(asked_for(fields, actions, ["field_id"]).select(
        "field_id", removable(fields).alias("_can"), F.col("field_name").alias("_name")), "removals")
    gone = status.filter("_can").select("field_id")
    outcome = keyed_join(actions, status, ["field_id"], "left").join(
        actions.groupBy("field_id").agg(F.min_by("action_id", F.struct("ts", "action_id")).alias("_first")),
        "field_id")
    refusal = (F.when(F.col("_can").isNull() | (F.col("_can") & (F.col("action_id") != F.col("_first"))),
                      K.REFUSED_NO_FIELD).when(~F.col("_can"), K.REFUSED_REMOVE))
    report = outcome.select("action_id", "field_id", F.col("_name").alias("field_name"),
                            F.when(refusal.isNull(), "removed").otherwise("refused").alias("outcome"),
                            refusal.alias("refusal"))
    return fields.join(gone, "field_id", "left_anti"), report


def apply_rejections(documents: DataFrame, actions: DataFrame) -> DataFrame:
    """One outcome per reject action; the first one on an open document wins.

    ``documents``: doc_id, status, extraction_mode.
    """
    first = actions.groupBy("doc_id").agg(
        F.min_by("action_id", F.struct("ts", "action_id")).alias("_first"))
    state = documents.select("doc_id", "status", "extraction_mode").join(first, "doc_id")
    a = keyed_join(actions, state, ["doc_id"], "left")
    label = F.coalesce(F.try_element_at(F.create_map(*[
        F.lit(x) for kv in K.REJECTION_REASONS for x in kv]), F.col("_code")), F.lit("Other"))
    a = a.withColumn("_code", F.coalesce(F.nullif(F.col("reason_code"), F.lit("")), F.lit("other")))
    note = strip(F.coalesce("reason", F.lit("")))
    stored = F.when(note == "", label).otherwise(F.concat(label, F.lit(": "), note))
    open_ = F.col("status").isin(K.PENDING, K.NEEDS_REVIEW) | (
        (F.col("extraction_mode") == K.AUTO_DETECT) & (F.col("status") == K.APPROVED))
    refusal = (F.when(F.col("status").isNull(), K.REFUSED_NO_DOCUMENT)
               .when(~open_ | (F.col("action_id") != F.col("_first")), K.REFUSED_STATE))
    details = F.concat(F.lit("Document status changed from "), F.col("status"),
                       F.lit(" to rejected by "), F.col("actor"), F.lit(". Reason: "), stored,
                       F.lit(" (code: "), F.col("_code"), F.lit(")."))
    return a.withColumn("refusal", refusal).select(
        "action_id", "doc_id", "ts", "actor",
        F.when(F.col("refusal").isNull(), "rejected").otherwise("refused").alias("outcome"), "refusal",
        F.when(F.col("refusal").isNull(), stored).alias("stored_reason"),
        F.when(F.col("refusal").isNull(), details).alias("details"))


def rejection_audit(rejections: DataFrame) -> DataFrame:
    actions = F.explode(F.array(F.lit("document_rejected"), F.lit("document_state_changed")))
    return (rejections.filter("outcome = 'rejected'")
            .select("doc_id", actions.alias("action"), "actor", "details"))


# --- audit -----------------------------------------------------------------------------------

def audit_rows(df: DataFrame, action: str, actor: str, details: Column) -> DataFrame:
    return df.select("doc_id", F.lit(action).alias("action"), F.lit(actor).alias("actor"),
                     details.alias("details"))


def audit_text(action: str, shown: dict[str, Column] | None = None) -> Column:
    """The text of an audit action with its columns filled in; ``shown`` replaces columns by expressions."""
    shown = shown or {}
    parts = re.split(r"\{(\w+)\}", K.AUDIT_TEXTS[action])
    return F.concat(*[shown.get(x, F.col(x)).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts) if i % 2 or x])


def creation_audit(documents: DataFrame) -> DataFrame:
    """Audit rows of new documents: doc_id, parser_type, extraction_mode, document_type_label (NULL without a chosen template)."""
    chosen = F.when(F.col("document_type_label").isNotNull(), audit_text("template_selected")).otherwise(audit_text("no_template_selected"))
    rows = F.array(F.struct(F.lit("document_created").alias("action"), F.concat(audit_text("document_created"), chosen).alias("details")),
                   F.struct(F.lit("job_queued").alias("action"), audit_text("job_queued").alias("details")))
    return documents.select("doc_id", F.explode(rows).alias("_a")).select("doc_id", "_a.action", F.lit("api").alias("actor"), "_a.details")


def addition_audit(added: DataFrame) -> DataFrame:
    """Audit rows of what apply_additions has added."""
    return added.where("outcome = 'added'").select("doc_id", F.lit("field_manually_added").alias("action"), "actor",
                                                   audit_text("field_manually_added").alias("details"))


def removal_audit(removals: DataFrame) -> DataFrame:
    """Audit rows of removed fields: the report of apply_removals with doc_id, actor and display_value."""
    return removals.where("outcome = 'removed'").select("doc_id", F.lit("field_removed").alias("action"), "actor",
                                                        audit_text("field_removed").alias("details"))


def job_audit(jobs: DataFrame) -> DataFrame:
    """Audit rows of jobs that did not finish: doc_id, job_id, ending, error, provider, model, window_type, quota, retry_at.

    ending: rejected_before, rejected_while, deferred or failed; other endings leave no row.
    """
    ending = F.col("ending")
    kinds = {"rejected_before": "processing_skipped_rejected_document", "rejected_while": "processing_write_skipped_rejected_document",
             "deferred": "ai_rate_limited_job_deferred"}
    row = F.when(ending == "failed", F.struct(F.lit("processing_failed").alias("action"), F.col("error").alias("details")))
    for name, action in kinds.items():
        row = row.when(ending == name, F.struct(F.lit(action).alias("action"), audit_text(action).alias("details")))
    return jobs.select("doc_id", F.explode(F.array_compact(F.array(row))).alias("_a")).select(
        "doc_id", "_a.action", F.lit("worker").alias("actor"), "_a.details")


def briefing_audit(briefed: DataFrame) -> DataFrame:
    """Audit rows of briefings: doc_id, provider, model, limited, error (NULL unless the model's quota was used up, or it failed).

    A briefing by a model has one row; else what kept the model away, if anything, and the deterministic briefing that stands in.
    """
    by_model = F.col("provider") != "system"
    reason = (F.when(F.col("limited").isNotNull(), F.concat(F.lit("provider quota was reached: "), "limited"))
              .when(F.col("error").isNotNull(), F.concat(F.lit("provider failed non-fatally: "), "error"))
              .otherwise(K.BRIEFING["default_reason"]))
    row = lambda action, **shown: F.struct(F.lit(action).alias("action"), audit_text(action, shown).alias("details"))
    rows = F.array_compact(F.array(
        F.when(by_model, row("ai_review_assistant_completed")),
        F.when(~by_model & F.col("limited").isNotNull(), row("ai_review_assistant_deferred_or_skipped", error=F.col("limited"))),
        F.when(~by_model & F.col("limited").isNull() & F.col("error").isNotNull(), row("ai_review_assistant_skipped")),
        F.when(~by_model, row("ai_review_assistant_fallback_created", reason=reason))))
    return briefed.select("doc_id", F.explode(rows).alias("_a")).select("doc_id", "_a.action", F.lit("worker").alias("actor"), "_a.details")


def processing_audit(runs: DataFrame, threshold: float = K.DEFAULT_THRESHOLD) -> DataFrame:
    """Audit rows of finished runs (doc_id, job_id, strategy, status, accepted_fields, review_fields).

    All rows of a run come from one projection, not from a union of scans.
    """
    s = lambda c: F.col(c).cast("string")
    row = lambda action, details, actor="worker": F.struct(
        F.lit(action).alias("action"), F.lit(actor).alias("actor"), details.alias("details"))
    rows = F.array_compact(F.array(
        row("processing_started", F.concat(
            F.lit("Job "), s("job_id"), F.lit(" started from PostgreSQL state."))),
        row("extraction_strategy_selected", F.concat(
            F.lit("Extraction strategy: "), F.col("strategy"), F.lit("."))),
        row("structured_fields_auto_accepted", F.concat(
            F.lit("Auto-accepted "), s("accepted_fields"), F.lit(" field(s); "), s("review_fields"),
            F.lit(" field(s) still require review. Confidence threshold: "
                  f"{round(threshold * 100)}%. Validation rules were applied to extracted/template "
                  "fields. AI Review Assistant: created."))),
        row("processing_finished", F.concat(
            F.lit("Job "), s("job_id"), F.lit(" completed and extraction rows committed. Document "
                                              "status is "), F.col("status"), F.lit("."))),
        F.when(F.col("status") == K.APPROVED, row("document_approved", F.lit(
            "Document approved automatically by the system because all extracted fields were "
            "accepted during deterministic structured-data processing and no fields require "
            "review."), "system"))))
    return runs.select("doc_id", F.explode(rows).alias("_a")).select("doc_id", "_a.*")


# --- briefings -------------------------------------------------------------------------------

#: Documents with more fields than this have their lists limited before the shuffle.
CROWDED = 2_000


def _flag_totals() -> list[Column]:
    """Counts and average of flagged fields, as aggregates."""
    return [F.count(F.lit(1)).alias("n"), F.count_if("_missing").alias("n_missing"), F.count_if("_invalid").alias("n_invalid"),
            F.count_if("_low").alias("n_low"), mean("confidence", 3).alias("avg_confidence")]


_FLAGS = {"missing": "_missing", "failures": "_invalid", "low": "_low"}


def _said(kind: str) -> Column:
    return F.concat("field_name", F.lit(": "), "_message") if kind == "failures" else F.col("field_name")


def _gathered(flagged: DataFrame, listed: int) -> DataFrame:
    """Totals and lists of documents with few fields: the fields are shuffled once and met in one aggregate, nothing is ranked."""
    # dealt out first: few fields of a document are in one task before the shuffle, so that an aggregate there only costs
    lists = [F.collect_list(F.when(F.col(flag), F.struct("pos", _said(kind).alias("said")))).alias(kind)
             for kind, flag in _FLAGS.items()]
    found = flagged.repartition("doc_id").groupBy("doc_id").agg(*_flag_totals(), *lists)
    for kind in _FLAGS:
        found = found.withColumn(kind, F.transform(F.slice(F.sort_array(kind), 1, listed), lambda x: x["said"]))
    return found


def _limited(flagged: DataFrame, listed: int) -> DataFrame:
    """Totals and lists of documents of any size: both are reduced before the shuffle, lists by ranks."""
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(flag).alias("_on"), _said(kind).alias("said"))
                      for kind, flag in _FLAGS.items()])
    top = flagged.select("doc_id", "pos", F.inline(kinds)).filter("_on").withColumn("_rn", F.row_number().over(
        Window.partitionBy("doc_id", "kind").orderBy("pos", "said"))).filter(F.col("_rn") <= listed)
    lists = top.groupBy("doc_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(
        F.col("kind") == kind, F.struct("_rn", "said")))), lambda x: x["said"]).alias(kind) for kind in _FLAGS])
    return flagged.groupBy("doc_id").agg(*_flag_totals()).join(lists, "doc_id", "left")


def briefings(documents: DataFrame, fields: DataFrame, threshold: float = K.DEFAULT_THRESHOLD,
              listed: int = 12, reason: str = K.BRIEFING["default_reason"],
              use_validation: bool = True, crowded: int = CROWDED) -> DataFrame:
    """Reviewer briefing per document.

    ``documents``: doc_id, filename, document_type_label, document_type_key, strategy. ``fields``: doc_id, pos,
    field_name, value, required, confidence, validation_status, validation_message. At most
    ``listed`` names of a kind are gathered per document; counts and the average cover all rows. Documents of more than
    ``crowded`` fields are counted first and limited before the shuffle. ``use_validation=False`` leaves validation results out.
    """
    say = K.BRIEFING
    invalid = (F.col("validation_status") == "invalid") & F.lit(use_validation)
    # a field without a document meets none; a message is said of invalid fields only
    flagged = fields.filter(F.col("doc_id").isNotNull()).select(
        "doc_id", "pos", "field_name", "confidence", F.when(invalid, F.col("validation_message")).alias("_message"),
        (F.col("required") & is_blank(F.col("value"))).alias("_missing"), invalid.alias("_invalid"),
        R.low_confidence(F.col("confidence"), threshold).alias("_low"))
    # at most one in ``crowded`` rows is a key here
    hot = F.broadcast(fields.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > crowded).select("doc_id"))
    found = lambda rows, name: rows.select("doc_id", F.struct(*[c for c in rows.columns if c != "doc_id"]).alias(name))
    none = F.array().cast("array<string>")
    d = (documents.join(found(_gathered(flagged.join(hot, "doc_id", "left_anti"), listed), "_few"), "doc_id", "left")
         .join(found(_limited(flagged.join(hot, "doc_id", "left_semi"), listed), "_many"), "doc_id", "left")
         .withColumn("_found", F.coalesce("_few", "_many")).select(*documents.columns, "_found.*")
         .fillna(0, ["n", "n_missing", "n_invalid", "n_low"]).fillna(0.0, ["avg_confidence"]))
    for c in ("missing", "failures", "low"):
        d = d.withColumn(c, F.coalesce(c, none))
    joined = lambda head, c: F.array(F.concat(F.lit(head), F.array_join(c, ", ")))
    issues = F.concat(
        F.when(F.col("n_missing") > 0, joined(say["missing"], "missing")).otherwise(none),
        F.col("failures"), F.when(F.col("n_low") > 0, joined(say["low"], "low")).otherwise(none),
        F.when(F.col("n") == 0, F.array(F.lit(say["none"]))).otherwise(none))
    # the template's name, else its key
    label = F.nullif(F.col("document_type_label"), F.lit(""))
    if "document_type_key" in documents.columns:
        label = F.coalesce(label, F.nullif(F.col("document_type_key"), F.lit("")))
    checks = F.array_compact(F.array(
        F.when(label.isNotNull(), F.concat(F.lit(say["template"]), label, F.lit(".")))
        .otherwise(say["no_template"]),
        F.when(F.col("n_missing") == 0, say["ok_required"]),
        F.when(F.col("n_invalid") == 0, say["ok_validation"])))
    d = d.withColumn("issues", issues).withColumn("checks", checks)
    quality = (F.when((F.col("n_invalid") > 0) | (F.col("n_missing") >= 3), "poor")
               .when(F.size("issues") > 0, "needs_review").otherwise("good"))
    summary = F.concat(
        F.lit("Deterministic reviewer briefing generated for "),
        F.coalesce(F.nullif(F.col("filename"), F.lit("")), F.lit("this document")),
        F.lit(". Extraction strategy: "), F.col("strategy"), F.lit(f". {reason}."))
    return d.select(
        "doc_id", F.lit("system").alias("provider"), F.lit("deterministic-review").alias("model"),
        summary.alias("summary"), F.col("avg_confidence").alias("overall_confidence"),
        quality.alias("document_quality"),
        F.when(F.size("issues") > 0, say["issues"]).otherwise(say["clean"]).alias("recommendation"),
        "issues", "checks")


def latest_briefing(stored: DataFrame) -> DataFrame:
    """Newest briefing per document; its two JSON lists become arrays (unreadable ones are empty)."""
    rest = [c for c in stored.columns if c != "doc_id"]
    newest = stored.groupBy("doc_id").agg(
        F.max_by(F.struct(*rest), F.struct("created_at", "briefing_id")).alias("_b"))
    as_list = lambda c: F.filter(F.coalesce(F.from_json(F.col("_b")[c], "array<string>"),
                                            F.array().cast("array<string>")),
                                 lambda x: F.coalesce(x, F.lit("")) != "")
    return newest.select("doc_id", *[
        (as_list(c) if c in ("issues_json", "checks_json") else F.col("_b")[c])
        .alias(c.replace("_json", "")) for c in rest])


def review_progress(documents: DataFrame, displayed: DataFrame) -> DataFrame:
    """Counts a reviewer sees per document and the status after all is resolved."""
    ok = F.col("accepted") & ~F.col("needs_review")
    official = F.coalesce(F.col("standard_field_key"), F.lit("")) != ""
    required = official & F.col("required")
    counts = displayed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("fields"), F.count_if("needs_review").alias("to_review"),
        F.count_if(~F.col("accepted")).alias("unaccepted"), F.count_if("accepted").alias("accepted"),
        F.count_if(required).alias("required_total"),
        F.count_if(required & ok & ~is_blank(F.col("display_value"))).alias("required_done"),
        F.count_if(F.startswith("field_name", F.lit(K.SUGGESTED))).alias("extras"),
        F.count_if(ok).alias("_resolved"))
    names = ["fields", "to_review", "unaccepted", "accepted", "required_total", "required_done",
             "extras", "_resolved"]
    d = documents.join(counts, "doc_id", "left").fillna(0, names)
    resolved = (F.col("fields") > 0) & (F.col("_resolved") == F.col("fields"))
    return d.select(
        "doc_id", *names[:-1],
        F.when(F.col("fields") > 0, F.floor(F.col("accepted") * 100 / F.col("fields") + 0.5))
        .otherwise(0).cast("bigint").alias("percent_accepted"),
        F.when((F.col("status") == K.NEEDS_REVIEW) & resolved, K.APPROVED)
        .otherwise(F.col("status")).alias("effective_status"))
