"""One CASE expression that checks a value against its type and the template's rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fieldmill import constants as K
from fieldmill.functions.common import bind, is_blank, parse_amount, strings, strip, title
from fieldmill.schemas import RULES

DATE_SHAPE = r"^([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/]([0-9]{4}|[0-9]{2}))$"


def is_date(text: Column) -> Column:
    parsed = F.coalesce(*[F.try_to_date(text, f) for f in K.DATE_FORMATS])
    return F.rlike(text, F.lit(DATE_SHAPE)) & parsed.isNotNull()


def is_email(text: Column) -> Column:
    return F.rlike(text, F.lit(K.EMAIL_FULL))


def check(value: Column, data_type: Column, required: Column, rules: Column | None = None) -> Column:
    """struct(rule, ok, detail): the first rule that applies and its verdict, each tested once."""
    rules = F.lit(None).cast(RULES) if rules is None else rules
    required = F.coalesce(required, F.lit(False))
    none = F.lit(None).cast("string")

    def result(rule, ok, detail=none):
        ok = F.coalesce(ok, F.lit(False)) if isinstance(ok, Column) else F.lit(ok)
        return F.struct(F.lit(rule).alias("rule"), ok.alias("ok"), detail.alias("detail"))

    def given(listed, default):
        return F.when(F.size(listed) > 0, listed).otherwise(strings(default))

    def typed(text, kind):
        def money(amount):
            symbol = F.exists(given(rules["currencies"], K.DEFAULT_CURRENCIES),
                              lambda c: F.contains(F.lower(text), F.lower(c)))
            return (amount.isNotNull()
                    & (~F.coalesce(rules["require_currency_symbol"], F.lit(False)) | symbol)
                    & (rules["min"].isNull() | (amount >= rules["min"])))

        amount = parse_amount(text)
        allowed = given(rules["allowed"], K.DEFAULT_CODES)
        code = F.array_contains(F.transform(allowed, lambda c: F.upper(c)), F.upper(text))
        minimum = F.coalesce(rules["min_length"], F.when(required, 1).otherwise(0))
        return (
            F.when(kind == "email", result("email", is_email(text)))
            .when(kind == "date", result("date", is_date(text)))
            .when(kind == "currency", result("currency", bind(amount, money)))
            .when(kind == "currency_code", result("currency_code", code, F.array_join(allowed, ", ")))
            .when(kind == "percentage", result("percentage", amount.between(0, 100)))
            .when(kind == "number", result("number", amount.isNotNull()))
            .when(kind == "integer", result("integer", amount == F.floor(amount)))
            .when(F.length(text) < minimum, result("string_min_length", False, minimum.cast("string")))
            .when((F.coalesce(rules["pattern"], F.lit("")) != "") & ~F.rlike(text, rules["pattern"]),
                  result("regex", False))
            .otherwise(result("string", True)))

    blank = is_blank(value)
    return (
        F.when(blank & required, result("required", False)).when(blank, result("optional_empty", True))
        .otherwise(bind(strip(value), lambda text: bind(
            F.lower(F.coalesce(data_type, F.lit("string"))), lambda kind: typed(text, kind)))))


def explain(checked: Column, name: Column) -> Column:
    """struct(status, message, rule, requires_review) of a check."""
    rule, ok, detail, say = checked["rule"], checked["ok"], checked["detail"], K.VALIDATION_TEXT
    status = (F.when(rule == "required", "missing_required").when(rule == "optional_empty", "not_applicable")
              .when(ok, "valid").otherwise("invalid"))
    message = F.when(rule == "required", F.concat(
        title(F.replace(name, F.lit("_"), F.lit(" "))), F.lit(say["missing"])))
    message = message.when(rule == "optional_empty", say["optional"])
    for kind in ("string", "email", "date", "currency", "currency_code", "percentage", "number", "integer"):
        good = say["number" if kind == "integer" else kind]
        message = message.when((rule == kind) & ok, good if kind == "string" else good[0])
    for kind in ("email", "date", "currency", "percentage", "number", "integer"):
        message = message.when(rule == kind, say["number" if kind == "integer" else kind][1])
    message = (message
               .when(rule == "currency_code", F.concat(F.lit(say["currency_code"][1]), detail, F.lit(".")))
               .when(rule == "string_min_length", F.concat(
                   F.lit(say["min_length"][0]), detail, F.lit(say["min_length"][1])))
               .otherwise(say["pattern"]))
    return F.struct(status.alias("status"), message.alias("message"), rule.alias("rule"),
                    (~ok).alias("requires_review"))


def validate(name: Column, value: Column, data_type: Column, required: Column,
             rules: Column | None = None) -> Column:
    """struct(status, message, rule, requires_review) in one expression."""
    return bind(check(value, data_type, required, rules), lambda c: explain(c, name))
