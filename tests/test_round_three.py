"""Findings of round three: what is broadcast, shuffled and read, held on small rows."""

import re

import pytest
from pyspark.sql import functions as F

from fieldmill.catalogue import Catalogue
from fieldmill.operators import analytics, records, results, review, skew, templates
from fieldmill.sources import csv_ranges
from workload.all import QUERIES
from workload.registry import Tables
from workload.templates import _with_rules

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def by_shuffle(spark):
    """Nothing is small enough for a broadcast that no one asks for, as on large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_prompt_lines_are_never_broadcast(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "doc_id long, raw_text string").select(
        "*", *[F.lit("x").alias(c) for c in ("filename", "parser_type", "extraction_mode", "document_type_label", "document_type_key", "strategy")])
    fields = spark.createDataFrame([(1, i, f"f{i}") for i in range(3)], "doc_id long, pos long, field_name string").select(
        "*", *[F.lit("v").alias(c) for c in ("standard_field_key", "value", "data_type")], F.lit(0.5).alias("confidence"), F.lit(True).alias("required"))
    made = results.review_prompts(docs, fields)
    assert "Broadcast" not in plan_of(made)
    got = {r.doc_id: r.prompt for r in made.collect()}
    assert [got[1].index(f'"f{i}"') for i in range(3)] == sorted(got[1].index(f'"f{i}"') for i in range(3)) and got[2] is None


def test_rows_per_key_meet_without_a_broadcast(spark):
    big, small = spark.range(20).selectExpr("id % 3 as k", "id"), spark.range(2).selectExpr("id as k", "id as v")
    assert "Broadcast" not in plan_of(skew.keyed_join(big, small, ["k"]))


def test_fields_that_no_one_asks_for_are_not_shuffled(spark):
    fields = spark.range(1000).selectExpr("id as field_id", "concat('name ', id) as field_name")
    actions = spark.createDataFrame([(3,), (3,), (None,)], "field_id long")
    asked = skew.asked_for(fields, actions, ["field_id"])
    assert "hashpartitioning" not in plan_of(asked) and [r.field_id for r in asked.collect()] == [3]


def test_audit_events_and_reviewer_actions_broadcast_no_fields(spark):
    plan = plan_of(QUERIES["audit_events"](spark, SMALL))
    # what is broadcast are written lists of keys, the catalogue, and the actors of removals; never the fields
    for part in re.findall(r"BroadcastExchange.*?(?=\n.*?BroadcastExchange|\Z)", plan, re.S):
        assert "Generate explode(sequence(0, 5" not in part.split("Exchange", 2)[1]
    for name in ("new_corrections", "apply_accepts", "apply_corrections", "reviewed_states"):
        plan = plan_of(QUERIES[name](spark, SMALL))
        assert plan.count("asked-for") >= 1


def test_few_corrections_leave_the_fields_where_they_are(spark):
    for name in ("auto_accept_exact", "review_progress"):
        plan = plan_of(QUERIES[name](spark, SMALL))
        assert "latest-corrections" in plan and not re.search(r"hashpartitioning\(field_id#", plan)


def test_template_columns_stay_out_of_the_shuffle(spark):
    rows = templates.apply_template(_with_rules(Tables(spark, SMALL)), Catalogue.bundled())
    aggregates = re.findall(r"max_by\((.*?)\)", plan_of(rows.select("doc_id", "value")), re.S)
    assert aggregates and not any("template_name" in a or "template_key" in a for a in aggregates)


def test_template_keeps_what_rows_of_unknown_templates_have(spark):
    given = "doc_id long, pos long, doc_template string, field_name string, value string, confidence double"
    rows = spark.createDataFrame([
        (1, 0, "finance_invoice", "Invoice No", "a", 0.5), (1, 1, "finance_invoice", "invoice_number", "b", 0.9),
        (1, 2, "finance_invoice", "Odd", None, 0.4), (1, 2, "finance_invoice", "Odd", None, 0.4),
        (2, 0, "unheard", "Total", "c", None), (3, None, None, "Total", "d", 0.1)], given)
    for c in ("snippet", "reasoning", "standard_field_key", "template_key", "data_type"):
        rows = rows.withColumn(c, F.when(F.col("doc_id") > 1, F.lit(f"own {c}")))
    from fieldmill.schemas import RULES, SOURCE
    rows = rows.withColumn("auto_accept", F.lit(False)).withColumn("required", F.lit(True)).withColumn(
        "rules", F.lit(None).cast(RULES)).withColumn("source", F.lit(None).cast(SOURCE))
    got = {(r.doc_id, r.field_name): r for r in templates.apply_template(rows, Catalogue.bundled()).collect() if r.confidence != 0}
    best, odd, free = got[1, "invoice_number"], got[1, "suggested_extra_fields.odd"], got[2, "Total"]
    assert (best.value, best.pos, best.template_key, best.required, best.rules.min_length) == ("b", 1, "finance_invoice", True, 1)
    assert (odd.value, odd.pos, odd.data_type, odd.required, odd.auto_accept) == (None, 2, "suggestion", False, True)
    assert (free.value, free.pos, free.standard_field_key, free.data_type, free.required) == ("c", 0, "own standard_field_key", "own data_type", True)
    assert len(got) == 4


def test_positions_need_one_shuffle_of_the_rows(by_shuffle):
    rows = by_shuffle.createDataFrame([(k, i) for k in (1, None) for i in range(7)], "k long, i long")
    ranked = skew.row_index(rows, ["k"], F.floor(F.col("i") / 3), ["i"], "pos")
    plan = plan_of(ranked)
    assert len(re.findall(r"Exchange hashpartitioning\(_at", plan)) <= 3 and "coalesce(k" not in plan
    assert all(r.pos == r.i for r in ranked.collect())


def test_pages_of_documents_are_known_beforehand(by_shuffle):
    docs = by_shuffle.createDataFrame([(1, "a"), (1, "again"), (2, "b"), (None, "c")], "doc_id long, filename string")
    fields = by_shuffle.range(5).selectExpr("1 as doc_id", "id as field_id", "'n' as field_name", "'v' as extracted_value", "0.5 as confidence",
                                            "true as accepted", "false as needs_review")
    fixes = by_shuffle.createDataFrame([(9, 3)], "correction_id long, field_id long").selectExpr("*", "'o' old_value", "'x' corrected_value", "'u' corrected_by")
    jobs = by_shuffle.range(3).selectExpr("if(id = 0, 2, 7) as doc_id", "id as job_id", "'s' as status", "1 as attempts")
    briefs = by_shuffle.range(3).selectExpr("1 as doc_id", "id as briefing_id", "'s' as summary")
    view = analytics.document_view(docs, fields, fixes, jobs, briefs, page_size=2)
    # what was gathered by document and page is not dealt out again by document alone
    assert "Join [doc_id" in plan_of(view) and "FullOuter" not in plan_of(view)
    got = sorted(((r.filename, r.page, len(r.fields or []), len(r.jobs or []), len(r.briefings or [])) for r in view.collect()))
    one = [(0, 2, 0, 2), (1, 2, 0, 1), (2, 1, 0, 0)]
    assert got == sorted([("b", 0, 0, 1, 0), ("c", 0, 0, 0, 0), *[(n, *x) for n in ("a", "again") for x in one]])


def test_small_ranges_share_tasks_and_batches(spark, tmp_path):
    rows = [f'{i},"say ""{i}""\nand more"' if i % 2 else f"{i},plain" for i in range(400)]
    (tmp_path / "a.csv").write_text("k,note\n" + "\n".join(rows) + "\n")
    lines = csv_ranges.lines_of(spark, str(tmp_path / "a.csv"), 64)
    assert lines.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    _, found = csv_ranges.read_csv_records(spark, str(tmp_path / "a.csv"), 64)
    got = {r.record: tuple(c["value"] for c in r.cells) for r in found.collect()}
    assert got == {i: (str(i), f'say "{i}"\nand more' if i % 2 else "plain") for i in range(400)}


def test_required_keys_are_reduced_by_hash(spark):
    rows = spark.createDataFrame([(1, "finance_invoice", "invoice_number", " ", True), (1, "finance_invoice", "invoice_number", "x", True),
                                  (1, "finance_invoice", "notes", "x", False)],
                                 "doc_id long, doc_template string, standard_field_key string, value string, required boolean")
    done = templates.required_complete(rows, Catalogue.bundled())
    assert plan_of(done).count("HashAggregate(keys=[doc_id") >= 2
    (row,) = done.collect()
    assert (row.found, row.complete) == (1, False)


def test_describing_rows_without_leaves(spark, monkeypatch):
    docs = spark.createDataFrame([(1, '[{"a":1},{"b":2}]'), (2, "nope")], "doc_id long, text string")
    every, heads = records.json_fields(docs), records.json_fields(docs, leaves=False)
    assert heads.where("not is_head and shape is not null").count() == 0
    key = lambda df: sorted((r.pos, r.field_name, r.value) for r in df.where("is_head").collect())
    assert key(every) == key(heads)


def test_display_values_of_null_and_repeated_keys(spark):
    fields = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "field_id long, extracted_value string")
    fixes = spark.createDataFrame([(1, None, 5, 1), (None, "z", 5, 2)], "field_id long, corrected_value string, corrected_at long, correction_id long")
    got = sorted(((r.field_id or 0, r.corrected, r.display_value) for r in review.display_values(fields, fixes).collect()))
    assert got == [(0, False, "b"), (1, True, None), (1, True, None)]


def test_fields_are_worked_out_once(spark):
    from fieldmill.operators import ingest
    from fieldmill.plans import process
    docs = spark.createDataFrame([(1, "Invoice\nInvoice No: 7"), (2, None)], "doc_id long, raw_text string").select(
        "*", F.lit("plain_text").alias("parser_type"), F.lit("auto_detect").alias("extraction_mode"), F.lit(None).cast("string").alias("document_type_key"))
    done = process.process_text(docs, Catalogue.bundled())
    rows = process.field_rows(done)
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    assert plan_of(rows).count("Deterministically extracted") == 1
    assert rows.count() == sum(len(r.fields or []) for r in done.collect()) and rows.where("doc_id = 1").count() > 0
    texts = spark.createDataFrame([(1, "a;b\n1;2\n"), (2, ""), (3, None)], "doc_id long, text string")
    cells = records.csv_fields(ingest.parse_csv(texts))
    assert plan_of(cells).count("structured_csv") == 1
    assert sorted(r.pos for r in cells.where("doc_id = 1").collect()) == list(range(7))


def test_briefings_rank_only_the_fields_of_crowded_documents(spark):
    docs = spark.createDataFrame([(1, "a.txt"), (2, None), (3, "c"), (1, "again"), (None, "n")], "doc_id long, filename string").select(
        "*", F.lit("T").alias("document_type_label"), F.lit("deterministic").alias("strategy"))
    names = ["Total", "Total 2", None, "a", "a1"]
    # two fields at each place and some without one, so that names and messages decide: `a` < `a1`, but `a1: x` < `a: x`
    fields = [(doc, None if i == 7 else i // 2, names[i % 5], [None, "", "v"][i % 3], [True, False, None][i % 4 % 3],
               [0.2, None, 0.9, 0.123456][i % 4], ["invalid", "valid", None][i % 7 % 3], [None, "y", "x"][i % 3])
              for doc, n in ((1, 60), (2, 9), (None, 30), (77, 4)) for i in range(n)]
    rows = spark.createDataFrame(fields, "doc_id long, pos long, field_name string, value string, required boolean, confidence double, "
                                         "validation_status string, validation_message string")

    def said(doc, kind):
        low_first = lambda x: (x is not None, x)
        of = [f for f in fields if f[0] == doc is not None]
        if kind == "v":
            found = [(f[1], None if None in (f[2], f[7]) else f"{f[2]}: {f[7]}") for f in of if f[6] == "invalid"]
        else:
            found = [(f[1], f[2]) for f in of if (f[4] and not f[3] if kind == "m" else (f[5] or 0.0) < 0.8)]
        return [x for _, x in sorted(found, key=lambda f: [low_first(x) for x in f])][:12]

    def issues(doc):
        joined = [head + ", ".join(x for x in said(doc, kind) if x is not None) for kind, head in (
            ("m", "Missing required fields: "), ("l", "Low-confidence fields require review: ")) if said(doc, kind)]
        none = [] if any(f[0] == doc is not None for f in fields) else ["No extracted fields were produced for this document."]
        return joined[:-1] + said(doc, "v") + joined[-1:] + none

    ordered = lambda df: sorted(map(str, df.collect()))
    few = review.briefings(docs, rows)
    assert {r.doc_id: r.issues for r in few.collect()} == {doc: issues(doc) for doc in (1, 2, 3, None)}
    for crowded in (0, 9, 59, 60):
        assert ordered(review.briefings(docs, rows, crowded=crowded)) == ordered(few)
    # no document is crowded: what ran has no window, and the fields went through one exchange, as they are, and one of counts
    assert "Window" in plan_of(few).split("== Initial Plan ==")[-1]
    ran = plan_of(few).split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in ran and "Window" not in ran and "REPARTITION_BY_COL" in ran
