"""Which template fits a document, and the template as a contract on its fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldmill import constants as K
from fieldmill.catalogue import Catalogue
from fieldmill.functions.common import bind, is_blank, normalize_key, strings
from fieldmill.schemas import FIELD_COLUMNS, field

UNKNOWN_ORDER = 9999


def template_scores(low: Column, catalogue: Catalogue) -> Column:
    """array<struct(score, back, key)>: how many terms of each template a lower-case text contains.

    Longer terms are only looked for where the shortest term inside them was found, so a text pays
    for the few stems and not for every term of the catalogue.
    """
    if not catalogue.templates:
        return F.array().cast("array<struct<score:int,back:int,key:string>>")
    terms = sorted({x for t in catalogue.templates for x in t.terms()}, key=lambda x: (len(x), x))
    groups: dict[str, list[str]] = {}
    for term in terms:
        stem = next((g for g in groups if g in term), term)
        groups.setdefault(stem, []).append(term)
    # built from plain literals, which Spark folds into one constant; a term comes with its count in every template that has it
    weights = {x: [(i, t.terms().count(x)) for i, t in enumerate(catalogue.templates) if x in t.terms()] for x in terms}
    stems = F.array(*[F.struct(F.lit(g).alias("stem"), F.array(*[F.struct(F.lit(x).alias("term"), F.array(*[
        F.struct(F.lit(i).alias("at"), F.lit(n).alias("n")) for i, n in weights[x]]).alias("weights")) for x in ts]).alias("terms"))
        for g, ts in groups.items()])
    table = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(-i).alias("back"), F.lit(t.key).alias("key"))
                      for i, t in enumerate(catalogue.templates)])

    def hits(text):
        found = F.filter(stems, lambda g: F.contains(text, g["stem"]))
        return F.flatten(F.flatten(F.transform(found, lambda g: F.transform(F.filter(
            g["terms"], lambda x: F.contains(text, x["term"])), lambda x: x["weights"]))))

    def scores(hit):
        return F.transform(table, lambda t: F.struct(
            F.aggregate(hit, F.lit(0), lambda n, w: n + F.when(w["at"] == t["at"], w["n"]).otherwise(0)).alias("score"),
            t["back"].alias("back"), t["key"].alias("key")))
    return bind(low, lambda text: bind(hits(text), scores))


def infer_template(low: Column, parser_type: Column, requested: Column,
                   catalogue: Catalogue) -> Column:
    """The asked template, else the best scoring one (at least 2 hits, ties to the first file)."""
    best = bind(F.array_max(template_scores(low, catalogue)),
                lambda b: F.when(b["score"] >= 2, b["key"]))
    return (F.when((F.coalesce(requested, F.lit("")) != "") & (requested != "auto"), requested)
            .when(~parser_type.isin("json", "csv"), best))


def resolve_template(docs: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Adds low_text and template_key: by mode none, the document's own, or the inferred one."""
    return docs.withColumn("low_text", F.lower("raw_text")).withColumn("template_key", F.when(
        F.col("extraction_mode") != K.DISCOVERY,
        F.coalesce(F.col("document_type_key"), infer_template(
            F.col("low_text"), F.col("parser_type"), F.lit(None).cast("string"), catalogue))))


def settle_mode(docs: DataFrame, catalogue: Catalogue) -> DataFrame:
    """After a run: the applied template gives key, label and mode; none clears them."""
    applied, asked = F.col("applied_template"), F.col("extraction_mode") == K.TEMPLATE
    return docs.select(
        *[c for c in docs.columns if c not in ("document_type_key", "document_type_label",
                                               "extraction_mode")],
        F.when(applied.isNotNull(), applied).when(asked, F.col("document_type_key"))
        .alias("document_type_key"),
        F.when(applied.isNotNull(), catalogue.label_of(applied))
        .when(asked, F.col("document_type_label")).alias("document_type_label"),
        F.when(applied.isNotNull() & ~asked, K.AUTO_DETECT).otherwise(F.col("extraction_mode"))
        .alias("extraction_mode"))


# --- matching --------------------------------------------------------------------------------

def name_forms(whole: Column, name: Column) -> list[Column]:
    """Forms of a field name that may equal a template synonym, or NULL. ``whole``: its normalized key."""
    tail = F.when(F.contains(name, F.lit(".")),
                  normalize_key(F.substring_index(name, ".", -1)))
    row = F.when(F.startswith(whole, F.lit("records_")), F.nullif(F.regexp_extract(whole, r"^records_[0-9]+_(.*)$", 1), F.lit("")))
    return [whole, tail, row]


def name_candidates(name: Column) -> Column:
    """name_forms as an array without NULLs."""
    return bind(normalize_key(name), lambda whole: F.array_compact(F.array(*name_forms(whole, name))))


def match_fields(fields: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Adds ``match`` (template field or NULL) to rows carrying ``doc_template``.

    Broadcasts of the size-checked catalogue: every form of a name is looked up among the synonyms of its template by their hash, and
    no row carries them.
    """
    profile = catalogue.profiles(fields.sparkSession)
    synonyms = profile.select(F.col("template_key").alias("doc_template"), F.explode("synonyms").alias("_form", "_at"))
    known = profile.select(F.col("template_key").alias("doc_template"), "template_name", "template_fields")
    found = fields.withColumn("_whole", normalize_key(F.col("field_name")))
    for i, form in enumerate(name_forms(F.col("_whole"), F.col("field_name"))):
        found = found.withColumn(f"_form{i}", form).join(F.broadcast(synonyms.select(
            "doc_template", F.col("_form").alias(f"_form{i}"), F.col("_at").alias(f"_at{i}"))), ["doc_template", f"_form{i}"], "left")
    order = F.least("_at0", "_at1", "_at2")
    return found.join(F.broadcast(known), "doc_template", "left").select(
        "doc_template", *[c for c in fields.columns if c != "doc_template"], "template_name", F.get("template_fields", order).alias("match"))


def record_prefix(name: Column) -> Column:
    """`records[2].a` for `records[2].a.b`; '' for other names."""
    return F.regexp_extract(name, r"(?s)^(records\[.*)\.[^.]*$", 1)


def canonicalise(matched: DataFrame, *carried: str) -> DataFrame:
    """Official names and template columns for matched rows, suggestion names for the others."""
    m, known = F.col("match"), F.col("match").isNotNull()
    in_template = F.col("template_name").isNotNull()
    prefix = record_prefix(F.col("field_name"))
    official = F.when(prefix != "", F.concat(prefix, F.lit("."), m["key"])).otherwise(m["key"])
    safe = F.coalesce(F.nullif(normalize_key(F.col("field_name")), F.lit("")), F.lit("unknown_field"))
    change = {
        "field_name": (official, F.concat(F.lit(K.SUGGESTED), safe)),
        "standard_field_key": (m["key"], F.lit(None)),
        "template_key": (F.col("doc_template"), F.lit(None)),
        "data_type": (m["data_type"], F.lit("suggestion")),
        "required": (m["required"], F.lit(False)),
        "rules": (m["rules"], F.col("rules")),
        "auto_accept": (F.col("auto_accept"), F.lit(True)),
    }
    return matched.select(
        "doc_id", "pos", "doc_template", "template_name", *carried, *[
            (F.when(known, change[c][0]).when(in_template, change[c][1]).otherwise(F.col(c))
             if c in change else F.col(c)).alias(c) for c in FIELD_COLUMNS])


def collapse_duplicates(fields: DataFrame) -> DataFrame:
    """Per (document, name) the row of highest confidence, the first one on ties.

    An aggregate, not a window: every task keeps one row per name before the shuffle.
    """
    rest = [c for c in fields.columns if c not in ("doc_id", "field_name")]
    best = F.max_by(F.struct(*rest), F.struct("confidence", -F.col("pos")))
    return (fields.groupBy("doc_id", "field_name").agg(best.alias("_b"))
            .select("doc_id", "field_name", *[F.col("_b")[c].alias(c) for c in rest])
            .select(*fields.columns))


def missing_required(matched: DataFrame, catalogue: Catalogue,
                     documents: DataFrame | None = None) -> DataFrame:
    """Empty rows for required fields that no row of the document matches (once per document).

    ``matched``: doc_id, doc_template, standard_field_key. ``documents`` (doc_id, doc_template)
    adds documents without any row. The found keys of a document are a set no larger than its
    template; each is reduced to one row per task before the shuffle, and only keys are shuffled.
    """
    found = matched.filter("doc_template is not null").select("doc_id", "doc_template", "standard_field_key").distinct().groupBy(
        "doc_id", "doc_template").agg(F.collect_set("standard_field_key").alias("_found"))
    if documents is not None:
        found = (documents.filter("doc_template is not null").select("doc_id", "doc_template")
                 .join(found, ["doc_id", "doc_template"], "left")
                 .withColumn("_found", F.coalesce("_found", F.array().cast("array<string>"))))
    profile = catalogue.profiles(matched.sparkSession).select(
        F.col("template_key").alias("doc_template"), "template_name", "template_fields")
    absent = F.filter("template_fields", lambda f: f["required"] & ~F.array_contains(
        F.col("_found"), f["key"]))
    rows = found.join(F.broadcast(profile), "doc_template").select(
        "doc_id", "doc_template", "template_name", F.explode(absent).alias("_t"))
    reason = F.concat(F.lit('Required field from template "'), F.col("template_name"),
                      F.lit('" was missing and must be reviewed manually.'))
    item = field(F.col("_t.key"), "", 0.0, K.MISSING_SNIPPET, reason)
    rows = rows.select("doc_id", "doc_template", "template_name", "_t", item.alias("_f"))
    stamped = {"standard_field_key": F.col("_t.key"), "template_key": F.col("doc_template"),
               "data_type": F.col("_t.data_type"), "required": F.col("_t.required")}
    return rows.select("doc_id", F.col("_t.order").alias("pos"), "doc_template", "template_name", *[
        stamped.get(c, F.col("_f")[c]).alias(c) for c in FIELD_COLUMNS])


def record_number(name: Column) -> Column:
    """2 for `records[2]...`; 0 for other names."""
    return F.coalesce(F.regexp_extract(name, r"^records\[([0-9]+)\]", 1).try_cast("bigint"),
                      F.lit(0).cast("bigint"))


def order_columns(fields: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Adds the template order of each row: section, is_record, record, field_order, tie_break.

    Sorting by (doc_id, these) gives template order for official rows, then suggestions as they
    came. A range sort on them splits even one huge document over many tasks.
    """
    profile = catalogue.profiles(fields.sparkSession).select(
        F.col("template_key").alias("doc_template"), "field_order")
    official = F.col("standard_field_key").isNotNull()
    name = F.col("field_name")
    key = F.coalesce(F.col("standard_field_key"), F.substring_index(name, ".", -1))
    order = F.coalesce(F.try_element_at("field_order", key), F.lit(UNKNOWN_ORDER))
    zero = F.lit(0).cast("bigint")
    return (fields.join(F.broadcast(profile), "doc_template", "left")
            .withColumn("section", F.when(official, 0).otherwise(1))
            .withColumn("is_record", F.when(official & F.startswith(name, F.lit("records[")), 1)
                        .otherwise(0))
            .withColumn("record", F.when(official, record_number(name)).otherwise(zero))
            .withColumn("order", F.when(official, order).otherwise(0))
            .withColumn("tie_break", F.when(official, F.lit(0).cast("bigint"))
                        .otherwise(F.col("pos").cast("bigint")))
            .drop("field_order"))


ORDER_BY = ["doc_id", "section", "is_record", "record", "order", "tie_break", "field_name"]


def apply_template(fields: DataFrame, catalogue: Catalogue,
                   documents: DataFrame | None = None) -> DataFrame:
    """Match, rename, collapse, add missing required rows, keep the rest as suggestions.

    Rows without ``doc_template`` pass through untouched. The others are shuffled once: official
    rows meet under their name, suggestions keep a key of their own. What the template says of a row is
    looked up again behind the shuffle, and the found keys of a document are shuffled on their own.
    """
    free = fields.filter("doc_template is null").select("doc_id", "pos", "doc_template", *FIELD_COLUMNS)
    ruled = fields.filter("doc_template is not null").withColumn("_given", F.struct(
        "pos", "field_name", "value", F.col("source.json_path").alias("path")))
    matched = match_fields(ruled, catalogue)
    named = canonicalise(matched.withColumn("_order", F.col("match.order")), "_given", "_order")
    missing = missing_required(named, catalogue, documents)
    alone = F.col("standard_field_key").isNull() | F.col("template_name").isNull()
    own = F.when(alone, F.col("_given"))
    # what the template gives, and what the row's own key holds, stays out of the shuffle
    given = ["standard_field_key", "template_key", "data_type", "required"]
    rest = [c for c in FIELD_COLUMNS if c not in (*given, "field_name", "value", "rules")]
    kept = named.groupBy("doc_id", "field_name", own.alias("_own")).agg(F.max_by(F.struct(
        "doc_template", "_order", *rest, F.when(~alone, F.col("pos")).alias("pos"), F.when(~alone, F.col("value")).alias("value"),
        F.when(F.col("_order").isNull(), F.col("rules")).alias("rules"),
        F.when(F.col("template_name").isNull(), F.struct(*given)).alias("_free")), F.struct("confidence", -F.col("pos"))).alias("_b"))
    profile = catalogue.profiles(fields.sparkSession).select(
        F.col("template_key").alias("doc_template"), "template_name", "template_fields")
    kept = kept.select("doc_id", "field_name", "_own", "_b.*").join(F.broadcast(profile), "doc_template", "left")
    m, known, lone = F.get("template_fields", F.col("_order")), F.col("_order").isNotNull(), F.col("_own").isNotNull()
    of_template = {"standard_field_key": (m["key"], F.lit(None)), "template_key": (F.col("doc_template"), F.lit(None)),
                   "data_type": (m["data_type"], F.lit("suggestion")), "required": (m["required"], F.lit(False))}
    again = {c: F.when(known, a).when(F.col("template_name").isNotNull(), b).otherwise(F.col("_free")[c]) for c, (a, b) in of_template.items()}
    again["rules"] = F.when(known, m["rules"]).otherwise(F.col("rules"))
    again |= {c: F.when(lone, F.col("_own")[c]).otherwise(F.col(c)) for c in ("pos", "value")}
    kept = kept.select(*[again.get(c, F.col(c)).alias(c) for c in ("doc_id", "pos", "doc_template", *FIELD_COLUMNS)])
    return kept.unionByName(missing.drop("template_name")).unionByName(free)


def display_order(stored: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Adds category, record and field_order for stored rows (doc_template may be NULL).

    Official, suggested, manually added, other; then record, template order, id, name. Documents
    without a template keep id order.
    """
    profile = catalogue.profiles(stored.sparkSession).select(
        F.col("template_key").alias("doc_template"), "field_order")
    name, key = F.col("field_name"), F.coalesce(
        F.nullif(F.col("standard_field_key"), F.lit("")),
        F.substring_index(F.col("field_name"), ".", -1))
    has = F.col("field_order").isNotNull()
    category = (F.when(F.coalesce(F.col("standard_field_key"), F.lit("")) != "", 0)
                .when(F.startswith(name, F.lit(K.SUGGESTED)), 1)
                .when(F.contains(F.coalesce("reasoning", F.lit("")), F.lit(K.MANUAL_MARK)), 2)
                .otherwise(3))
    return (stored.join(F.broadcast(profile), "doc_template", "left")
            .withColumn("category", F.when(has, category).otherwise(0))
            .withColumn("record", F.when(has, record_number(name)).otherwise(F.lit(0).cast("bigint")))
            .withColumn("order", F.when(has, F.coalesce(
                F.try_element_at("field_order", key), F.lit(UNKNOWN_ORDER))).otherwise(0))
            .drop("field_order"))


DISPLAY_BY = ["doc_id", "category", "record", "order", "field_id", "field_name"]


# --- strategy --------------------------------------------------------------------------------

def required_complete(labelled: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Per document: are all required keys of its template labelled with a non-blank value?"""
    key = F.when(F.col("required") & ~is_blank(F.col("value")), F.col("standard_field_key"))
    found = labelled.select("doc_id", "doc_template", key.alias("_key")).distinct().groupBy("doc_id", "doc_template").agg(
        F.collect_set("_key").alias("_found"))
    profile = catalogue.profiles(labelled.sparkSession).select(
        F.col("template_key").alias("doc_template"), "required_keys")
    return found.join(F.broadcast(profile), "doc_template").select(
        "doc_id", "doc_template", F.size("_found").alias("found"),
        F.size("required_keys").alias("required_count"),
        ((F.size("required_keys") > 0) & (F.size(F.array_except("required_keys", "_found")) == 0))
        .alias("complete"))


def strategy(complete: Column, has_labelled: Column, eligible: Column, cached: Column,
             fresh: Column, error: Column, provider: Column, model: Column,
             template_key: Column, limited: Column | None = None, fall_back: Column | None = None,
             defer: Column | None = None) -> Column:
    """Name of the cheapest sufficient strategy; the first that applies wins. NULL where the run ends without one (see outcome).

    complete: labelled values suffice; cached / fresh: a stored / new model result with fields; error: the model failed;
    limited: its quota was used up (what it said); fall_back: deterministic fields replace what the model does not give (default:
    yes); defer: with the quota used up the run waits for the next window (default: yes).
    """
    limited = F.lit(None).cast("string") if limited is None else limited
    fall_back = F.lit(True) if fall_back is None else fall_back
    waits, fails = _unfinished(complete, eligible, cached, error, limited, fall_back, defer)
    suffix = F.when(template_key.isNotNull(), F.concat(F.lit(":template:"), template_key)).otherwise("")
    run = F.concat(provider, F.lit(":"), model)
    return (F.when(complete, F.concat(F.lit("deterministic_labelled"), suffix))
            .when(eligible & cached, F.concat(F.lit("ai_cache:"), run, suffix))
            .when(waits | fails, None)
            .when(eligible & limited.isNotNull(),
                  F.concat(F.lit("deterministic_fallback_after_ai_rate_limit:"), provider))
            .when(eligible & error.isNotNull(),
                  F.concat(F.lit("deterministic_fallback_after_ai_error:"), provider))
            .when(eligible & (fresh | has_labelled), F.concat(F.lit("ai:"), run, suffix))
            .when(eligible & ~fall_back, F.concat(F.lit("ai:"), run, F.lit(":empty")))
            .otherwise(F.concat(F.when(has_labelled, "deterministic_labelled")
                                .otherwise("deterministic"), suffix)))


def _unfinished(complete, eligible, cached, error, limited, fall_back, defer):
    """(the run waits for its quota, the run fails) as two conditions."""
    asked = ~complete & eligible & ~cached
    defer = F.lit(True) if defer is None else defer
    waits = asked & limited.isNotNull() & defer
    fails = asked & ~fall_back & ((limited.isNotNull() & ~defer) | (limited.isNull() & error.isNotNull()))
    return waits, fails


def outcome(complete: Column, eligible: Column, cached: Column, error: Column, limited: Column, fall_back: Column,
            defer: Column) -> Column:
    """How the run of a document ends: done, deferred (quota used up) or failed (the model failed and nothing replaces it)."""
    waits, fails = _unfinished(complete, eligible, cached, error, limited, fall_back, defer)
    return F.when(waits, "deferred").when(fails, "failed").otherwise("done")


def choose_fields(decisions: DataFrame, labelled: DataFrame, model: DataFrame,
                  generic: DataFrame) -> DataFrame:
    """The field rows each document's strategy asks for, as one union.

    ``decisions``: doc_id, strategy, error, and limited where quotas count. Every branch is cut down by its own join first.
    Documents without a strategy, and those with an empty model result, have no rows.
    """
    if "limited" not in decisions.columns:
        decisions = decisions.withColumn("limited", F.lit(None).cast("string"))
    decisions = decisions.where("strategy is not null")
    plan = decisions.select("doc_id", "strategy", "error", "limited")
    use_model = F.startswith("strategy", F.lit("ai"))
    labelled = labelled.join(decisions.select("doc_id"), "doc_id", "left_semi")
    complete = F.startswith("strategy", F.lit("deterministic_labelled")) & F.col("complete")
    flags = decisions.select("doc_id", use_model.alias("_model"), complete.alias("_complete"))
    of_model = model.join(flags.filter("_model"), "doc_id", "left_semi")
    of_text = generic.join(flags.filter("not _model and not _complete"), "doc_id", "left_semi")
    fallback = plan.filter(F.startswith("strategy", F.lit("deterministic_fallback"))).select(
        "doc_id", F.lit(1_000_000).alias("pos"), field(
            "ai_fallback_reason", F.coalesce("limited", "error"), 0.45, F.left(F.coalesce("limited", "error"), F.lit(500)),
            F.when(F.col("limited").isNotNull(), K.FALLBACK_LIMIT_REASON).otherwise(K.FALLBACK_ERROR_REASON)).alias("_f")).select(
                "doc_id", "pos", "_f.*")
    return (labelled.unionByName(of_model).unionByName(of_text)
            .unionByName(fallback, allowMissingColumns=True))
