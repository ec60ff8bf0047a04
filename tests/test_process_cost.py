"""the expressions over one document's fields copy nothing and rebuild nothing per column."""

from pyspark.sql import functions as F

from fieldmill.catalogue import Catalogue, Template, TemplateField
from fieldmill.functions.common import bind, title
from fieldmill.functions.text import labelled_fields
from fieldmill.operators.templates import template_scores
from fieldmill.plans.process import process_text


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bind_hands_on_without_a_copy(spark):
    df = spark.range(3).select("id", bind(F.when(F.col("id") > 0, F.col("id")), lambda v: F.struct((v + 1).alias("a"), v.alias("b"))).alias("x"))
    assert "transform(" not in plan_of(df)
    assert [(r.x.a, r.x.b) for r in df.orderBy("id").collect()] == [(None, None), (2, 1), (3, 2)]


def test_scores_look_up_no_maps(spark):
    catalogue = Catalogue([Template("k one", "Invoice", "general", aliases=["bill"], fields=[TemplateField("bill", "Bill date")]),
                           Template("k two", "Receipt", "general", aliases=["bill"])])
    texts = spark.createDataFrame([("a bill, general invoice",), ("receipt, bill date",), (None,)], "low string")
    df = texts.select("low", template_scores(F.col("low"), catalogue).alias("s"))
    assert "element_at" not in plan_of(df)
    got = {r.low: [(x.score, x.back, x.key) for x in r.s] for r in df.collect()}
    # a term that a template has twice counts twice
    assert got == {"a bill, general invoice": [(4, 0, "k one"), (2, -1, "k two")], "receipt, bill date": [(3, 0, "k one"), (2, -1, "k two")],
                   None: [(0, 0, "k one"), (0, -1, "k two")]}


def test_title_of_plain_and_other_letters(spark):
    rows = spark.createDataFrame([("iNVOICE no2x",), ("étude straße",), ("",), (None,)], "a string")
    df = rows.select(title(F.col("a")).alias("t"))
    assert "octet_length" in plan_of(df)
    assert [r.t for r in df.collect()] == ["Invoice No2X", "Étude Straße", "", None]


def test_labels_by_their_beginning(spark):
    catalogue = Catalogue([Template("t", "T", fields=[TemplateField("no", "Invoice No"), TemplateField("name", "Invoice Name"), TemplateField("way", "ΟΔΟΣ")])])
    text = "INVOICE  no_x: 1\n- Invoice_No = 2\ninvoice-name – 3\nInvoice Names: 4\nΟΔΟΣ:Χα\nInvoice No without"
    df = spark.createDataFrame([(text,)], "text string").crossJoin(F.broadcast(catalogue.profiles(spark))).select(F.inline(
        labelled_fields(F.col("text"), F.col("template_key"), F.col("labels"), F.col("template_fields"))))
    assert "startswith" in plan_of(df).lower()
    assert {r.standard_field_key: r.value for r in df.collect()} == {"no": "2", "name": "3", "way": "Χα"}


def test_renamed_fields_are_not_rebuilt_per_column(spark):
    docs = spark.createDataFrame([(1, "Invoice Number: A-1\nTotal Amount: RM 5.00\n")], "doc_id long, raw_text string").select(
        "*", F.lit("plain_text").alias("parser_type"), F.lit("template").alias("extraction_mode"), F.lit("finance_invoice").alias("document_type_key"))
    (row,) = process_text(docs, Catalogue.bundled()).collect()
    named = {f.standard_field_key: f.value for f in row.fields if f.standard_field_key}
    assert named["invoice_number"] == "A-1" and named["total_amount"] == "RM 5.00"
    assert all(f.validation_message.endswith("value was found.") for f in row.fields if f.validation_status == "missing_required")
