"""The data around a model step: prompts out, responses in, cache, quota and retry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldmill import constants as K
from fieldmill.functions.common import bind, strip
from fieldmill.operators.ingest import strict_json
from fieldmill.schemas import field

MINUTE_LIMIT, DAY_LIMIT, RETRY_PADDING_SECONDS = 30, 1000, 5


# --- responses -------------------------------------------------------------------------------

def lenient_json_object(text: Column) -> Column:
    """The JSON object in a response as text: fence removed, else first `{` to last `}`; or NULL."""
    def is_object(t):
        return F.startswith(F.schema_of_variant(strict_json(t)), F.lit("OBJECT"))

    def choose(clean):
        first = F.instr(clean, "{")
        last = F.length(clean) - F.instr(F.reverse(clean), "}") + 1
        inner = F.when((first > 0) & F.contains(clean, F.lit("}")) & (last > first),
                       F.substring(clean, first, last - first + 1))
        return F.when(is_object(clean), clean).otherwise(
            bind(inner, lambda t: F.when(is_object(t), t)))
    body = strip(text)
    fenced = F.regexp_replace(F.regexp_replace(body, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    return bind(F.when(F.startswith(body, F.lit("```")), fenced).otherwise(body), choose)


def _share(c: Column, default: float) -> Column:
    """A confidence as a share: percentages divided, clamped to 0..1, 4 places."""
    x = F.coalesce(c.try_cast("double"), F.lit(default))
    x = F.when(x > 1, x / 100).otherwise(x)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 4)


def _first_given(m: Column, *keys: str) -> Column:
    return F.coalesce(*[F.nullif(m[k], F.lit("")) for k in keys])


def model_fields(responses: DataFrame) -> DataFrame:
    """Responses (doc_id, provider, model, response) -> one row per usable field."""
    items = F.from_json(lenient_json_object(F.col("response")), "struct<fields:array<string>>")["fields"]
    rows = responses.select("doc_id", "provider", "model", F.posexplode(items).alias("pos", "_item"))
    m = F.from_json("_item", "map<string,string>")
    rows = rows.filter(F.startswith("_item", F.lit("{"))).withColumn("_m", m)
    m = F.col("_m")
    value = strip(F.coalesce(F.when(F.map_contains_key(m, "value"), m["value"])
                             .otherwise(m["extracted_value"]), F.lit("")))
    score = F.when(F.map_contains_key(m, "confidence"), m["confidence"]).when(
        F.map_contains_key(m, "confidence_score"), m["confidence_score"])
    out = rows.select(
        "doc_id", "provider", "model", "pos",
        F.left(strip(F.coalesce(_first_given(m, "field_name", "name"), F.lit(""))),
               F.lit(120)).alias("field_name"),
        value.alias("value"), _share(score, 0.7).alias("confidence"),
        F.left(strip(F.coalesce(_first_given(m, "source_snippet", "snippet"), value)),
               F.lit(1000)).alias("source_snippet"),
        F.left(strip(F.coalesce(_first_given(m, "explanation", "reasoning"),
                                F.lit(K.MODEL_DEFAULT_EXPLANATION))), F.lit(1000)).alias("explanation"))
    return out.filter("field_name <> '' and value <> ''")


def unusable_responses(responses: DataFrame) -> DataFrame:
    return responses.filter(lenient_json_object(F.col("response")).isNull()).select(
        "doc_id", F.lit(K.MODEL_OBJECT_ERROR).alias("error"))


def as_fields(rows: DataFrame) -> DataFrame:
    """Model field rows as ordinary field rows (reviewable, with the run in the reasoning)."""
    why = F.concat(F.lit("AI provider="), F.col("provider"), F.lit(", model="), F.col("model"),
                   F.lit(". "), F.col("explanation"))
    item = field(F.col("field_name"), F.col("value"), F.col("confidence"), F.col("source_snippet"), why)
    return rows.select("doc_id", "pos", item.alias("_f")).select("doc_id", "pos", "_f.*")


def model_reviews(responses: DataFrame) -> DataFrame:
    """Responses -> briefing columns with the documented defaults."""
    obj = F.coalesce(lenient_json_object(F.col("response")), F.lit("{}"))
    r = responses.select("doc_id", "provider", "model", F.try_parse_json(obj).alias("_v"),
                         F.from_json(obj, "map<string,string>").alias("_m"))
    m = F.col("_m")

    def texts(*paths):
        def one(path):
            v = F.try_variant_get("_v", path, "variant")
            listed = F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")),
                            F.try_variant_get("_v", path, "array<string>"))
            single = F.when(F.schema_of_variant(v) == "STRING",
                            F.array(F.try_variant_get("_v", path, "string")))
            kept = F.filter(F.transform(F.coalesce(listed, single), lambda x: F.left(
                strip(F.coalesce(x, F.lit("None"))), F.lit(500))), lambda x: x != "")
            return F.when(F.size(F.coalesce(listed, single)) > 0, kept)
        return F.coalesce(*[one(p) for p in paths], F.array().cast("array<string>"))

    score = F.when(F.map_contains_key(m, "overall_confidence"), m["overall_confidence"]).otherwise(
        m["confidence"])
    quality = F.left(F.replace(F.lower(strip(_first_given(m, "document_quality", "quality"))),
                               F.lit(" "), F.lit("_")), F.lit(80))
    return r.select(
        "doc_id", "provider", "model",
        F.left(strip(F.coalesce(_first_given(m, "summary"), F.lit(K.REVIEW_DEFAULT_SUMMARY))),
               F.lit(2000)).alias("summary"),
        _share(score, 0.0).alias("overall_confidence"),
        F.coalesce(F.nullif(quality, F.lit("")), F.lit("unknown")).alias("document_quality"),
        F.left(strip(F.coalesce(_first_given(m, "review_recommendation", "recommendation"),
                                F.lit(K.REVIEW_DEFAULT_RECOMMENDATION))), F.lit(2000))
        .alias("recommendation"),
        texts("$.issues", "$.potential_issues").alias("issues"),
        texts("$.consistency_checks").alias("checks"))


# --- prompts ---------------------------------------------------------------------------------

def extraction_prompts(docs: DataFrame, max_chars: int = 12_000) -> DataFrame:
    """(doc_id, parser_type, raw_text, contract) -> prompt; the model is the caller's business."""
    text = F.when(F.coalesce("contract", F.lit("")) != "", F.concat(
        F.col("contract"), F.lit("\n\nDocument content:\n"), F.col("raw_text"))).otherwise(F.col("raw_text"))
    return docs.select("doc_id", F.concat(
        F.lit("Parser type: "), F.col("parser_type"), F.lit("\n\nDocument text:\n---\n"),
        F.left(text, F.lit(max_chars)),
        F.lit("\n---\n\nExtract the fields now. Return JSON only.")).alias("prompt"))


def review_prompts(docs: DataFrame, fields: DataFrame, listed: int = 80, text_chars: int = 6_000,
                   max_chars: int = 14_000) -> DataFrame:
    """Briefing context per document: head of the text and the first fields as JSON lines."""
    line = F.to_json(F.struct("field_name", "standard_field_key", "value", "confidence", "required",
                              "data_type"), {"ignoreNullFields": "false"})
    first = (fields.withColumn("_rn", F.row_number().over(
                Window.partitionBy("doc_id").orderBy("pos", "field_name")))
             .filter(F.col("_rn") <= listed).select("doc_id", "_rn", line.alias("line")))
    lines = first.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("_rn", "line"))).alias("_l"))
    head = docs.select("doc_id", F.concat(
        F.lit("Document id: "), F.col("doc_id").cast("string"),
        F.lit("\nFilename: "), F.coalesce("filename", F.lit("None")),
        F.lit("\nParser: "), F.col("parser_type"), F.lit("\nExtraction mode: "), F.col("extraction_mode"),
        F.lit("\nTemplate: "), F.coalesce("document_type_label", "document_type_key", F.lit("None")),
        F.lit("\nExtraction strategy: "), F.col("strategy"),
        F.lit("\n\nOriginal parsed document text:\n"), F.left("raw_text", F.lit(text_chars)),
        F.lit("\n\nExtracted/template fields:\n")).alias("_head"))
    body = F.concat("_head", F.coalesce(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit("")))
    # the size of the lines cannot be told from that of the files they come from: never one broadcast table
    return head.join(lines.hint("merge"), "doc_id", "left").select("doc_id", F.concat(
        F.lit("Review this processed document package and produce a reviewer briefing.\n\n"
              "Context:\n---\n"), F.left(body, F.lit(max_chars)),
        F.lit("\n---\n\nReturn JSON only.")).alias("prompt"))


# --- cache -----------------------------------------------------------------------------------

def cache_key(content_hash: Column, parser_type: Column, template_key: Column, provider: Column,
              model: Column) -> Column:
    """SHA-256 over the dimensions that make a model result reusable."""
    parser = F.when(template_key.isNotNull(), F.concat(
        parser_type, F.lit(":template:"), template_key)).otherwise(parser_type)
    return F.sha2(F.concat_ws(":", content_hash, parser, provider, model).cast("binary"), 256)


def model_eligible(docs: DataFrame, parsers: list[str] = K.MODEL_PARSERS, enabled: bool = True) -> DataFrame:
    return docs.filter(F.lit(enabled) & F.col("parser_type").isin(parsers))


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds hit and the cached columns to each request (doc_id, cache_key)."""
    found = cache.select("cache_key", F.lit(True).alias("_hit"),
                         *[c for c in cache.columns if c != "cache_key"])
    return requests.join(found, "cache_key", "left").withColumn(
        "hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Each content to compute, once, with the first document that asks for it."""
    return (requests.join(cache.select("cache_key"), "cache_key", "left_anti")
            .groupBy("cache_key").agg(F.min("doc_id").alias("doc_id"),
                                      F.count(F.lit(1)).alias("requests")))


def cache_touch(cache: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """The cache after the look-ups: use counts raised, last use set."""
    hits = requests.groupBy("cache_key").agg(F.count(F.lit(1)).alias("_n"))
    used = F.coalesce("_n", F.lit(0))
    return cache.join(hits, "cache_key", "left").select(
        *[c for c in cache.columns if c not in ("use_count", "last_used_at")],
        (F.col("use_count") + used).alias("use_count"),
        F.when(used > 0, now).otherwise(F.col("last_used_at")).alias("last_used_at"))


def cache_upsert(cache: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """New results replace the stored fields and raise the count, or enter with count 1.

    ``results`` holds one row per cache_key.
    """
    body = [c for c in cache.columns if c not in ("cache_key", "use_count", "last_used_at")]
    new = results.select("cache_key", F.struct(*body).alias("_new"))
    old = cache.select("cache_key", F.struct(*body).alias("_old"), "use_count", "last_used_at")
    return old.join(new, "cache_key", "full_outer").select(
        "cache_key", *[F.coalesce("_new", "_old")[c].alias(c) for c in body],
        (F.coalesce("use_count", F.lit(0)) + F.col("_new").isNotNull().cast("int")).alias("use_count"),
        F.when(F.col("_new").isNotNull() & F.col("_old").isNotNull(), now)
        .otherwise(F.col("last_used_at")).alias("last_used_at"))


# --- quota -----------------------------------------------------------------------------------

def quota_admission(requests: DataFrame, minute_limit: int = MINUTE_LIMIT,
                    day_limit: int = DAY_LIMIT) -> DataFrame:
    """Adds admitted and refused_by (minute / day) to requests (request_id, ts, provider, model).

    Requests count in (ts, request_id) order; a refused one uses nothing up, the minute is checked
    first, a limit <= 0 is off. Since the admitted requests of a minute are its first ones, a
    minute needs only its count: how many may pass follows from a running sum over the minutes of
    the day, and the last passing request is the cut-off all others are compared with. No request
    is ranked beyond the minute limit, so a busy minute never has to be sorted as a whole.
    """
    key = ["provider", "model", "minute"]
    r = requests.withColumn("minute", F.date_trunc("minute", "ts"))
    per_minute = r.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "day", F.date_trunc("day", "minute"))
    can = F.least("n", F.lit(minute_limit)) if minute_limit > 0 else F.col("n")
    earlier = Window.partitionBy("provider", "model", "day").orderBy("minute").rowsBetween(
        Window.unboundedPreceding, -1)
    per_minute = per_minute.withColumn("can", can.cast("bigint"))
    used = F.coalesce(F.sum("can").over(earlier), F.lit(0))
    allowed = F.greatest(F.lit(0), F.least("can", F.lit(day_limit) - used)) if day_limit > 0 else F.col("can")
    per_minute = per_minute.withColumn("allowed", allowed.cast("bigint"))
    # Minutes that let everything or nothing pass need no cut-off.
    partial = per_minute.filter("allowed > 0 and allowed < n").select(*key, "allowed")
    most = max(x for x in (minute_limit, day_limit, 1) if x) if minute_limit <= 0 else minute_limit
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("ts", "request_id"))
    first = r.withColumn("_rn", rank).filter(F.col("_rn") <= most).select(*key, "_rn", "ts", "request_id")
    cut = (first.join(partial, key).filter("_rn = allowed")
           .select(*key, F.struct("ts", "request_id").alias("cut")))
    limits = per_minute.join(cut, key, "left").select(*key, "n", "allowed", "can", "cut")
    passes = (F.col("allowed") == F.col("n")) | (
        (F.col("allowed") > 0) & (F.struct("ts", "request_id") <= F.col("cut")))
    reason = (F.when(F.col("allowed") < F.col("can"), "day").otherwise("minute"))
    return (r.join(limits, key).withColumn("admitted", F.coalesce(passes, F.lit(False)))
            .withColumn("refused_by", F.when(~F.col("admitted"), reason))
            .select(*requests.columns, "admitted", "refused_by"))


def quota_windows(admitted: DataFrame, minute_limit: int = MINUTE_LIMIT,
                  day_limit: int = DAY_LIMIT) -> DataFrame:
    """Requests per provider, model and window. Days are summed from the minutes."""
    minutes = admitted.groupBy("provider", "model", F.window("ts", "1 minute").alias("w")).agg(
        F.count(F.lit(1)).alias("request_count")).select(
        "provider", "model", F.lit("minute").alias("window_type"),
        F.col("w.start").alias("window_start"), "request_count", F.lit(minute_limit).alias("limit_count"))
    days = minutes.groupBy("provider", "model", F.date_trunc("day", "window_start").alias("window_start")).agg(
        F.sum("request_count").alias("request_count")).select(
        "provider", "model", F.lit("day").alias("window_type"), "window_start", "request_count",
        F.lit(day_limit).alias("limit_count"))
    return minutes.unionByName(days)


def retry_schedule(refused: DataFrame, padding_seconds: int = RETRY_PADDING_SECONDS) -> DataFrame:
    """Adds reset_at (end of the refusing window plus padding) and wait_seconds (at least 60)."""
    minute = F.date_trunc("minute", "ts") + F.expr("interval 1 minute")
    day = F.date_trunc("day", "ts") + F.expr("interval 1 day")
    reset = F.when(F.col("refused_by") == "minute", minute).otherwise(day) + F.make_dt_interval(
        secs=F.lit(padding_seconds))
    seconds = F.floor((F.unix_micros("reset_at") - F.unix_micros("ts")) / 1_000_000)
    return (refused.withColumn("reset_at", reset)
            .withColumn("wait_seconds", F.greatest(F.lit(60), seconds).cast("bigint")))
