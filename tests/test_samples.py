"""Sample documents with the rows they must give."""

import pytest
from pyspark.sql import functions as F

from fieldmill.catalogue import Catalogue
from fieldmill.functions import labels as L
from fieldmill.functions.common import normalize_key, parse_amount
from fieldmill.functions.review import threshold_column
from fieldmill.functions.validation import validate
from fieldmill.operators import ingest as I, records as R, results as A, templates as TP
from fieldmill.plans import process as P

INVOICE = ("Invoice\nCustomer: demo@example.com\nDate: 2026-06-01\nTotal Amount: RM 1,250.00\n"
           "Call 1234567890 please\n")
ORDER = ("Purchase Order\nPO Number: PO-1\nProject: X\nSite: Y\nSupplier Name: Z\n"
         "Order Date: 2026-06-01\nTotal: RM 5\n")
NOTE = "Meeting note\nWe need a purchase order report for the site.\nBudget RM 3,000.00 on 2026-01-02, mail a@b.co\n"


def run(spark, *texts):
    docs = spark.createDataFrame([(i, t, "plain_text", "auto_detect", None) for i, t in enumerate(texts)],
                                 "doc_id int, raw_text string, parser_type string, extraction_mode string, document_type_key string")
    return P.process_text(docs, Catalogue.bundled())


def test_incomplete_invoice(spark):
    rows = P.field_rows(run(spark, INVOICE)).orderBy("pos").collect()
    assert [(r.field_name, r.value) for r in rows][:5] == [
        ("invoice_number", ""), ("supplier_name", ""), ("customer_name", "demo@example.com"),
        ("invoice_date", "2026-06-01"), ("total_amount", "RM 1,250.00")]
    assert [r.field_name.removeprefix("suggested_extra_fields.") for r in rows[5:]] == [
        "document_type", "summary", "email", "phone_or_reference_number"]
    assert rows[4].confidence == 0.98 and rows[4].accepted and rows[0].needs_review
    assert rows[0].validation_status == "missing_required"


def test_strategies_and_status(spark):
    got = {r.doc_id: (r.strategy, r.status) for r in run(spark, INVOICE, ORDER, NOTE, "hello").collect()}
    assert got == {
        0: ("deterministic_labelled:template:finance_invoice", "needs_review"),
        1: ("deterministic_labelled:template:construction_purchase_order", "approved"),
        2: ("deterministic:template:construction_purchase_order", "needs_review"),
        3: ("deterministic", "needs_review")}


def test_array_and_row_wise_contract_agree(spark):
    done = run(spark, INVOICE, ORDER, NOTE, "hello")
    raw = spark.createDataFrame([(i, t, "plain_text", "auto_detect", None) for i, t in enumerate([INVOICE, NOTE])],
                                "doc_id int, raw_text string, parser_type string, extraction_mode string, document_type_key string")
    from fieldmill.functions.text import generic_fields, labelled_fields
    c = Catalogue.bundled()
    d = TP.resolve_template(raw, c).join(F.broadcast(c.profiles(spark)), "template_key", "left")
    found = F.concat(labelled_fields(F.col("raw_text"), F.col("template_key"), F.col("labels"), F.col("template_fields")),
                     generic_fields(F.col("raw_text"), F.col("parser_type")))
    rows = d.select("doc_id", F.col("template_key").alias("doc_template"), F.posexplode(found).alias("pos", "_f")).select(
        "doc_id", "doc_template", "pos", "_f.*")
    flat = TP.apply_template(rows, c).select("doc_id", "field_name", "value", "confidence", "auto_accept")
    inside = P.field_rows(done).filter("doc_id in (0, 2)").select(
        F.when(F.col("doc_id") == 2, 1).otherwise(0).alias("doc_id"), "field_name", "value", "confidence", "auto_accept")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(flat) == key(inside)


def test_labels_of_every_form(spark):
    from fieldmill.catalogue import Catalogue, Template, TemplateField
    from fieldmill.functions.text import labelled_fields
    fields = [TemplateField("claim", "Claim"), TemplateField("claim_no", "Claim No"), TemplateField("mail", "E-mail", aliases=["mail: address"]),
              TemplateField("long", "one two three four five six seven eight nine ten"), TemplateField("first", "1) Name"), TemplateField("ü", "Über Größe")]
    profile = Catalogue([Template("t", "T", fields=fields)]).profiles(spark)
    text = ("  - 2. CLAIM__No -- \"X 1\"\nclaim - first\r\nclaim no: \nE-Mail = a@b.co\rmail: address: later\n"
            "One  two three four-five six seven eight nine ten — 'deep'\n1) Name: Ann\nÜBER-GRÖSSE: x\nüber  größe : 12\nclaims: none\n")
    rows = spark.createDataFrame([(text,)], "raw_text string").crossJoin(F.broadcast(profile)).select(F.inline(labelled_fields(
        F.col("raw_text"), F.col("template_key"), F.col("labels"), F.col("template_fields")))).collect()
    got = {r.field_name: (r.value, r.source.line) for r in rows}
    assert got == {"claim": ("first", 2), "claim_no": ("- \"X 1", 1), "mail": ("a@b.co", 4), "long": ("deep", 6), "first": ("Ann", 7), "ü": ("12", 9)}
    assert all(text[r.source.start:r.source.end] == r.value for r in rows if r.field_name not in ("claim_no", "long"))


def test_line_offsets_of_many_lines(spark):
    from fieldmill.functions.text import line_table
    text = "".join(f"{'x' * (i % 7)}{' ' * (i % 3)}\r\n" if i % 5 else f" y{i}\n" for i in range(9000))
    rows = spark.createDataFrame([(text,)], "t string").select(F.inline(line_table(F.col("t")))).collect()
    expected, at = [], 0
    for n, line in enumerate(text.split("\n")[:-1], 1):
        if line.strip():
            expected.append((n, at + len(line) - len(line.lstrip()), line.strip()))
        at += len(line) + 1
    assert [tuple(r) for r in rows] == expected


def test_spans_across_line_ends(spark):
    text = "  Total \n\n amount due:\tRM 5\nnext"
    got = spark.range(1).select(L.source_span(F.lit(text), F.lit(None), F.lit(None), F.lit(" total amount  DUE: RM"), F.lit(""), F.lit("")).alias("s")).first().s
    assert (got.matched, got.start, got.before, got.hit + got.after) == (True, 2, "  ", text[2:])
    none = spark.range(1).select(L.source_span(F.lit(text), F.lit(None), F.lit(None), F.lit("nowhere"), F.lit(None), F.lit("x y")).alias("s")).first().s
    assert (none.matched, none.before, none.hit, none.after) == (False, text, "", "")


def test_csv(spark):
    text = 'a;b;c\n1;"x;""y""\nz";3\n4;5\n6;7;8;9\n\n'
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    cells = I.csv_records(I.parse_csv(docs)).select("record", F.inline("cells")).collect()
    assert [tuple(r) for r in cells] == [
        (0, "a", "1"), (0, "b", 'x;"y"\nz'), (0, "c", "3"), (1, "a", "4"), (1, "b", "5"), (1, "c", None),
        (2, "a", "6"), (2, "b", "7"), (2, "c", "8"), (2, "null", "['9']")]


def test_json(spark):
    docs = spark.createDataFrame([(1, '{"a":1,"b":[1,{"c":null}],"d":{},"e":1.0}'), (2, '{"a":1} x'),
                                  (3, '[{"a":{"a":1},"k":[1,2]},5,[1,"é"]]'), (4, None), (5, '"a\\ud800"')], "doc_id int, text string")
    parsed = {r.doc_id: r for r in I.parse_json(docs).collect()}
    assert {i for i, r in parsed.items() if r.reject_reason} == {2, 4}
    assert parsed[3].raw_text.startswith('JSON document containing a list with 3 items.\n[\n  {\n    "a": {\n      "a": 1')
    leaves = R.flatten(docs.filter("doc_id = 1")).orderBy("pos").collect()
    assert [(r.path, r.leaf) for r in leaves] == [("a", "1"), ("b[0]", "1"), ("b[1].c", "null"), ("e", "1.0")]
    rows = R.json_array_fields(docs).orderBy("pos").collect()
    assert [(r.field_name, r.value) for r in rows] == [
        ("records[0].a", "1"), ("records[0].k.records[0]", "1"), ("records[0].k.records[1]", "2"), ("records[1]", "5"), ("records[2]", '[1, "é"]')]
    assert [r.value for r in R.json_scalar_fields(docs).orderBy("pos").collect()] == ["structured_json_str", chr(34) + "a\ufffd" + chr(34)]


def test_json_of_any_depth_is_flattened(spark):
    text = '{"a":' * 500 + '{"b":["[{",1]}' + "}" * 500
    docs = spark.createDataFrame([(1, text), (2, '{"x":1}'), (3, '"}{"')], "doc_id int, text string")
    rows = R.flatten(docs).collect()
    deep = ".".join("a" * 500) + ".b"
    assert sorted((r.path, r.leaf, r.too_deep) for r in rows) == sorted([
        (deep + "[0]", "[{", False), (deep + "[1]", "1", False), ("x", "1", False), ("value", "}{", False)])
    assert I.parse_json(docs).filter("shape = 'object' and reject_reason is null").count() == 2
    assert R.json_object_fields(docs).filter("not field_name in ('document_type', 'summary', 'schema_fields')").count() == 3


def test_json_below_the_depth_is_kept_and_marked(spark):
    docs = spark.createDataFrame([(1, '{"a":{"b":{"c":1}}}')], "doc_id int, text string")
    rows = R.flatten(docs, max_depth=2).collect()
    assert [(r.path, r.leaf, r.too_deep) for r in rows] == [("a.b", '{"c":1}', True)]


def test_repeated_members_and_very_long_strings(spark):
    docs = spark.createDataFrame([(1, '{"a":1,"b":2,"a":{"c":3}}'), (2, '["' + "x" * 21_000_000 + '"]')], "doc_id int, text string")
    assert [(r.path, r.leaf) for r in R.flatten(docs.filter("doc_id = 1")).orderBy("pos").collect()] == [("a.c", "3"), ("b", "2")]
    parsed = I.parse_json(docs).selectExpr("doc_id", "shape", "reject_reason", "length(raw_text) as n").collect()
    assert [(r.shape, r.reject_reason) for r in parsed] == [("object", None), ("array", None)] and parsed[1].n > 21_000_000


def test_many_leaves_leave_in_batches(spark):
    docs = spark.createDataFrame([(1, "[" + ",".join(f'{{"k":{i}}}' for i in range(45_000)) + "]"), (2, "[1]")], "doc_id int, text string")
    rows = R.json_array_fields(docs)
    assert rows.groupBy("doc_id").agg(F.count("*"), F.min("pos"), F.max("pos")).orderBy("doc_id").collect() == [
        (1, 45_000, 5, 45_004), (2, 1, 4, 4)]


def test_the_alias_written_first_wins_a_tie(spark):
    from fieldmill.catalogue import Catalogue
    from fieldmill.plans.process import process_structured, structured_documents, structured_fields
    docs = spark.createDataFrame([(1, '[{"supplier":"A","vendor":"B"}]', "json", "finance_invoice"), (2, "vendor,supplier\nB,A\n", "csv", "finance_invoice"),
                                  (3, '[{"vendor":"B","supplier":"A"}]', "json", "unheard_of"), (4, "{", "json", "finance_invoice")],
                                 "doc_id int, text string, parser_type string, document_type_key string")
    catalogue = Catalogue.bundled()
    rows = process_structured(docs, catalogue).collect()
    key = "records[0].supplier_name"
    assert {r.doc_id: r.value for r in rows if r.field_name == key} == {1: "A", 2: "B"}
    assert [r.field_name for r in rows if r.doc_id == 3][-2:] == ["records[0].vendor", "records[0].supplier"]
    done = {r.doc_id: r for r in structured_documents(structured_fields(docs, catalogue), catalogue).collect()}
    assert done[1].strategy == "deterministic:template:finance_invoice" and done[1].status == "needs_review"
    assert done[3].strategy == "deterministic" and done[3].applied_template is None and done[3].status == "approved"
    assert done[4].reject_reason == "Invalid JSON" and done[4].status is None


def test_structured_rows_are_read_once_and_not_shuffled(spark):
    from fieldmill.plans.process import structured_rows
    docs = spark.createDataFrame([(1, "[]", "json"), (2, "a\n1\n", "csv")], "doc_id int, text string, parser_type string")
    plan = structured_rows(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan ExistingRDD") == 2


@pytest.mark.parametrize("kind, value, status", [
    ("date", "2026-6-9", "valid"), ("date", "31/02/2026", "invalid"), ("date", "5/6/26", "valid"),
    ("date", "2026.06.09", "invalid"), ("currency", "RM 1,250.00", "valid"), ("currency", "1-2", "invalid"),
    ("currency_code", "RMM", "invalid"), ("percentage", "62%", "valid"), ("percentage", "101", "invalid"),
    ("integer", "7.5", "invalid"), ("string", " ", "not_applicable")])
def test_validation(spark, kind, value, status):
    v = validate(F.lit("x"), F.lit(value), F.lit(kind), F.lit(False))
    assert spark.range(1).select(v["status"].alias("s")).first().s == status


def test_small_functions(spark):
    r = spark.range(1).select(
        normalize_key(F.lit("Work Completed %")).alias("a"), parse_amount(F.lit("RM 1,250.00")).alias("b"),
        A.lenient_json_object(F.lit("[1]")).alias("c"), L.mode_label(F.lit("discovery")).alias("d"),
        L.pretty_json(F.lit("not json")).alias("e")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == ("work_completed", 1250.0, None, "Free Extraction", "not json")
    limits = spark.createDataFrame([("80",), ("1.5",), ("bad",), ("-3",)], "raw string")
    assert [r[0] for r in limits.select(threshold_column(F.col("raw"))).collect()] == [0.8, 0.015, 0.8, 0.0]


def test_scores_of_any_catalogue(spark):
    """Stems only save work: every term of the catalogue counts as often as it is listed."""
    c = Catalogue.bundled()
    low = ORDER.lower()
    want = {t.key: sum(x in low for x in t.terms()) for t in c.templates}
    got = spark.range(1).select(F.inline(TP.template_scores(F.lit(low), c))).collect()
    assert {r.key: r.score for r in got} == want


def test_quotes_inside_unquoted_cells(spark):
    text = 'item,size\r\npipe,5" wide\nrod,"7"" tall"\n\n"a\nb"x,c "d" e\n'
    (row,) = I.parse_csv(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert row.headers == ["item", "size"]
    assert row.rows == [["pipe", '5" wide'], ["rod", '7" tall'], ["a\nbx", 'c "d" e']]


def test_sets_without_records_have_their_summary(spark):
    from fieldmill.catalogue import Catalogue
    from fieldmill.plans.process import process_structured
    docs = spark.createDataFrame([(1, "[]", "json", None), (2, "a,b\n", "csv", None), (3, '\ufeff[{"k":1}]', "json", None), (4, '\ufeff{"k":1}', "json", None)],
                                 "doc_id int, text string, parser_type string, document_type_key string")
    rows = process_structured(docs, Catalogue.bundled()).collect()
    got = {(r.doc_id, r.field_name): r.value for r in rows}
    assert got[1, "summary"] == "0 JSON record(s)." and got[2, "summary"] == "0 CSV record(s)."
    assert got[3, "summary"] == "1 JSON record(s) with fields: k." and got[4, "summary"] == "JSON object with fields: k."
