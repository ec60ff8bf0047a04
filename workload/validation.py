"""Checks of values, each type on its own and all together."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmill import constants as K
from fieldmill.functions.common import parse_amount
from fieldmill.functions.validation import validate
from fieldmill.operators.review import validate_fields as validate_rows
from fieldmill.schemas import RULES
from workload import duck as D
from workload.registry import INPUTS, Tables, q, query

_SAY = K.VALIDATION_TEXT
# Values of every shape a type can meet, one list of cases repeated over the orders.
_VALUES = """
SELECT field_id, doc_id, name AS field_name, value, data_type, required, lo, minlen, pat, cur, allowed, must FROM (
SELECT f.*, CASE field_id % 4 WHEN 0 THEN 'po_number' WHEN 1 THEN 'suggested_extra_fields.email' ELSE field_name END AS name,
  CASE field_id % 8 WHEN 0 THEN 'email' WHEN 1 THEN 'date' WHEN 2 THEN 'currency' WHEN 3 THEN 'Currency_Code' WHEN 4 THEN 'percentage'
    WHEN 5 THEN 'number' WHEN 6 THEN 'integer' ELSE NULL END AS data_type, field_id % 3 = 0 AS required,
  CASE WHEN field_id % 5 = 0 THEN CAST(0 AS DOUBLE) WHEN field_id % 5 = 1 THEN CAST(100000 AS DOUBLE) END AS lo,
  CASE WHEN field_id % 7 = 0 THEN 9 END AS minlen, CASE WHEN field_id % 11 < 5 THEN '^[0-9 -]+$' END AS pat,
  field_id % 13 = 0 AS must, field_id % 2 = 0 AS cur, field_id % 9 = 0 AS allowed FROM (
    SELECT field_id, doc_id, field_name, CASE (field_id * 5) % 17 WHEN 0 THEN ' ' WHEN 1 THEN NULL WHEN 2 THEN ' a.b+c@example.co ' WHEN 3 THEN 'no@mail'
      WHEN 4 THEN 'usd' WHEN 5 THEN 'SGD' WHEN 6 THEN '62%' WHEN 7 THEN '101' WHEN 8 THEN '-5' WHEN 9 THEN '1-2' WHEN 10 THEN 'RM12A50'
      WHEN 11 THEN '12345' WHEN 12 THEN '7.50' ELSE value END AS value FROM """


def _values() -> str:
    return _VALUES + "(" + INPUTS["raw_fields"] + ") r) f) g"


def _check(part: str) -> str:
    """The CASE of the check; part is status, message or rule."""
    v, kind = D.strip("value"), "lower(coalesce(data_type, 'string'))"
    amount = D.amount(v)
    code_list = lambda xs: ", ".join(q(x) for x in xs)
    in_codes = f"CASE WHEN allowed THEN upper({v}) IN ('AUD', 'USD') ELSE upper({v}) IN ({code_list(K.DEFAULT_CODES)}) END"
    has = " OR ".join(f"contains(lower({v}), {q(c.lower())})" for c in K.DEFAULT_CURRENCIES)
    symbol = f"CASE WHEN cur THEN contains(lower({v}), 'rm') OR contains(lower({v}), 'sgd') ELSE {has} END"
    money = f"{amount} IS NOT NULL AND (NOT must OR {symbol}) AND (lo IS NULL OR {amount} >= lo)"
    tests = {"email": f"regexp_full_match({v}, {q(K.EMAIL_FULL[1:-1])})", "date": D.is_date(v), "currency": money,
             "currency_code": in_codes, "percentage": f"coalesce({amount} BETWEEN 0 AND 100, false)",
             "number": f"{amount} IS NOT NULL", "integer": f"coalesce({amount} = floor({amount}), false)"}
    def pick(status, message, rule):
        return {"status": status, "message": message, "rule": rule}[part]
    label = D.title("replace(field_name, '_', ' ')")
    out = (f"CASE WHEN {D.blank('value')} AND required THEN {pick(q('missing_required'), f'{label} || ' + q(_SAY['missing']), q('required'))} "
           f"WHEN {D.blank('value')} THEN {pick(q('not_applicable'), q(_SAY['optional']), q('optional_empty'))} ")
    for name, ok in tests.items():
        good, bad = _SAY["number" if name == "integer" else name]
        bad = q(bad)
        if name == "currency_code":
            bad += f" || CASE WHEN allowed THEN 'USD, AUD' ELSE {q(', '.join(K.DEFAULT_CODES))} END || '.'"
        status = f"CASE WHEN {ok} THEN 'valid' ELSE 'invalid' END"
        message = f"CASE WHEN {ok} THEN {q(good)} ELSE {bad} END"
        out += f"WHEN {kind} = {q(name)} THEN {pick(status, message, q(name))} "
    need = "coalesce(minlen, CASE WHEN required THEN 1 ELSE 0 END)"
    short = f"{q(_SAY['min_length'][0])} || {need} || {q(_SAY['min_length'][1])}"
    return out + (f"WHEN length({v}) < {need} THEN {pick(q('invalid'), short, q('string_min_length'))} "
                  f"WHEN pat IS NOT NULL AND NOT regexp_matches({v}, pat) THEN {pick(q('invalid'), q(_SAY['pattern']), q('regex'))} "
                  f"ELSE {pick(q('valid'), q(_SAY['string']), q('string'))} END")


_ALL = (f"SELECT field_id, {_check('status')} AS validation_status, {_check('message')} AS validation_message, "
        f"{_check('rule')} AS validation_rule FROM ({_values()}) v")


def checked(t: Tables):
    v = t.sql(_values())
    rules = F.struct(
        F.col("lo").alias("min"), F.lit(None).cast("double").alias("max"), F.col("minlen").cast("int").alias("min_length"),
        F.col("pat").alias("pattern"), F.when(F.col("cur"), F.array(F.lit("RM"), F.lit("SGD"))).alias("currencies"),
        F.when(F.col("allowed"), F.array(F.lit("USD"), F.lit("AUD"))).alias("allowed"),
        F.col("must").alias("require_currency_symbol"), F.lit(None).cast("array<string>").alias("formats")).cast(RULES)
    v = v.withColumn("rules", rules).withColumn("standard_field_key", F.lit(None).cast("string"))
    return validate_rows(v)


@query("validate_fields", _ALL)
def validate_fields(t: Tables):
    return checked(t).select("field_id", "validation_status", "validation_message", "validation_rule")


def _of_rule(name: str, rules: list[str]):
    listed = ", ".join(q(r) for r in rules)

    @query(name, f"SELECT * FROM ({_ALL}) c WHERE validation_rule IN ({listed})")
    def run(t: Tables):
        return validate_fields(t).filter(F.col("validation_rule").isin(rules))


_of_rule("validate_required", ["required", "optional_empty"])
_of_rule("validate_email", ["email"])
_of_rule("validate_date", ["date"])
_of_rule("validate_currency", ["currency"])
_of_rule("validate_currency_code", ["currency_code"])
_of_rule("validate_percentage", ["percentage"])
_of_rule("validate_number", ["number", "integer"])
_of_rule("validate_string", ["string_min_length", "regex", "string"])


@query("parse_amount", f"SELECT field_id, {D.amount('value')} AS amount FROM ({_values()}) v")
def parse_amount_query(t: Tables):
    return t.sql(_values()).select("field_id", parse_amount(F.col("value")).alias("amount"))
