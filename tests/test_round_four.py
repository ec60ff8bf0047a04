"""Findings of round four: work that must not grow with the square, or all over again, as tables grow."""

import re

import numpy as np
from pyspark.sql import functions as F

from fieldmill.catalogue import Catalogue
from fieldmill.llm import topk
from fieldmill.operators import analytics
from fieldmill.operators.templates import match_fields
from fieldmill.plans.process import structured_fields


def plan_of(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


# ---- F1: op10

def embeddings(spark, n=300):
    rnd = np.random.default_rng(5)
    return spark.createDataFrame([(k, rnd.normal(size=6).tolist()) for k in range(n)], "vec_id long, embedding array<double>")


def test_repeated_blocks_are_never_broadcast(spark, tmp_path):
    vectors = topk.sound_vectors(embeddings(spark), "vec_id", "embedding")
    topk.blocks(vectors, 40, 256).write.parquet(f"{tmp_path}/c")
    topk.blocks(vectors.where("id % 50 = 0"), 3, 256).write.parquet(f"{tmp_path}/q")
    queries, candidates = spark.read.parquet(f"{tmp_path}/q"), spark.read.parquet(f"{tmp_path}/c")
    work = topk.pairs(queries, candidates)
    assert work.count() == queries.count() * candidates.count() > 0
    # the two sides' numbers are, one row a length
    assert plan_of(work, "sparkPlan").count("SortMergeJoin") == 1 and plan_of(work, "sparkPlan").count("BroadcastHashJoin") == 2


def test_first_interval_holds_few_scores_of_a_block(spark, monkeypatch):
    kept, write = {}, topk.stored

    def stored(df, name):
        out = write(df, name)
        kept.setdefault(name, out)
        return out
    monkeypatch.setattr(topk, "stored", stored)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 40)
    rows = embeddings(spark)
    got = topk.top_k(rows, F.col("id") % 50 == 0, k=3).collect()
    whole = {r.vec_id: np.floor(256 * np.array(r.embedding)) for r in rows.collect()}
    scores = {q: {i: int(v @ whole[q]) for i, v in whole.items() if i != q} for q in range(0, 300, 50)}
    assert sorted(map(tuple, got)) == sorted((q, k + 1, i, s) for q, own in scores.items() for k, (i, s) in enumerate(
        sorted(own.items(), key=lambda x: (-x[1], x[0]))[:3]))
    first = kept["topk-state"].collect()
    ids = {r["row"]: r["id"] for r in kept["topk-vectors"].collect()}
    assert {ids[r.query] for r in first} == set(scores) and {r.want for r in first} == {3}
    for r in first:
        inside = sum(r.low <= s <= r.high for s in scores[ids[r.query]].values())
        assert 3 <= inside <= 3 * 8


# ---- F6: document_view

def test_children_of_small_documents_are_not_ranked(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "again"), (None, "d")], "doc_id long, filename string")
    owners = [1] * 7 + [2] * 2 + [None] * 5 + [9]
    fields = spark.createDataFrame([(d, i, "n", f"v{i}", 0.5, True, False) for i, d in enumerate(owners)] + [(2, None, "n", "v", 0.5, True, False)],
                                   "doc_id long, field_id long, field_name string, extracted_value string, confidence double, accepted boolean, needs_review boolean")
    fixes = spark.createDataFrame([(k, f, "o", f"c{k}", "u") for k, f in enumerate([7, 0, 7, 7, None, 3, 12])],
                                  "correction_id long, field_id long, old_value string, corrected_value string, corrected_by string")
    jobs = spark.createDataFrame([(3, k, "s", 1) for k in range(5)] + [(None, 9, "s", 1)], "doc_id long, job_id long, status string, attempts int")
    briefs = spark.createDataFrame([(2, 4, "x"), (None, 5, "y")], "doc_id long, briefing_id long, summary string")
    view = analytics.document_view(docs, fields, fixes, jobs, briefs, page_size=2)
    plan = plan_of(view, "optimizedPlan")
    # ranked are the children of documents with more than one page only, and those without a document not at all
    assert plan.count("Join LeftAnti") >= 4 and plan.count("RepartitionByExpression") == 3
    got = {(r.filename, r.page): ([(f.field_id, [c.correction_id for c in f.corrections or []]) for f in r.fields or []], [j.job_id for j in r.jobs or []],
                                  [b.briefing_id for b in r.briefings or []]) for r in view.collect()}
    assert got == {
        ("a", 0): ([(0, [1]), (1, [])], [], []), ("a", 1): ([(2, []), (3, [5])], [], []), ("a", 2): ([(4, []), (5, [])], [], []),
        ("a", 3): ([(6, [])], [], []), ("b", 0): ([(None, []), (7, [0, 2])], [], [4]), ("b", 1): ([(7, [3]), (8, [])], [], []), ("d", 0): ([], [], []),
        **{(n, p): ([], jobs, []) for n in ("c", "again") for p, jobs in enumerate([[0, 1], [2, 3], [4]])}}


# ---- F2, F5: process_structured, structured_documents

def test_rows_bring_their_template_along(spark):
    docs = spark.createDataFrame(
        [(1, '{"supplier": "A"}', "json", "finance_invoice"), (2, "[1,", "json", "finance_invoice"), (3, "vendor;n\nB;2\n", "csv", "finance_invoice"),
         (4, '{"x": 1}', "json", "own_kind"), (5, '{"x": 1}', "json", None), (None, '{"x": 1}', "json", "finance_invoice"), (None, "[1,", "json", "finance_invoice")],
        "doc_id long, text string, parser_type string, document_type_key string")
    rows = structured_fields(docs, Catalogue.bundled())
    # no field row looks for the template of its document
    assert not re.search(r"Join Inner, \(doc_id", plan_of(rows, "optimizedPlan"))
    done = rows.collect()
    assert {(r.doc_id, r.doc_template) for r in done} == {(1, "finance_invoice"), (2, None), (3, "finance_invoice"), (4, None), (5, None), (None, None)}
    assert [r.field_name for r in done if r.doc_id in (2, None)] == [None, None]
    named = {(r.doc_id, r.field_name): r.value for r in done if r.standard_field_key == "supplier_name"}
    assert named == {(1, "supplier_name"): "A", (3, "records[0].supplier_name"): "B"}


def test_names_are_looked_up_by_hash(spark):
    rows = spark.createDataFrame(
        [(1, "Supplier", "finance_invoice"), (2, "records[3].Vendor", "finance_invoice"), (3, "a.b.Invoice No", "finance_invoice"), (4, "records_2_vendor", "finance_invoice"),
         (5, "unheard of", "finance_invoice"), (6, None, "finance_invoice"), (7, "Supplier", "own_kind"), (8, "Supplier", None)],
        "doc_id long, field_name string, doc_template string")
    done = match_fields(rows, Catalogue.bundled())
    assert done.columns == ["doc_template", "doc_id", "field_name", "template_name", "match"] and "element_at" not in plan_of(done, "optimizedPlan")
    got = {r.doc_id: (r.template_name is not None, r.match and r.match.key) for r in done.collect()}
    assert got == {1: (True, "supplier_name"), 2: (True, "supplier_name"), 3: (True, "invoice_number"), 4: (True, "supplier_name"),
                   5: (True, None), 6: (True, None), 7: (False, None), 8: (False, None)}
