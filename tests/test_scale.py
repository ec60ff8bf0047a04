"""Hot groups, batching and reruns must not change results; simulations as brute force."""

import random
import re
from collections import defaultdict
from datetime import datetime, timedelta
from difflib import SequenceMatcher

from conftest import SMALL
from pyspark.sql import Window, functions as F

from fieldmill.catalogue import Catalogue
from fieldmill.operators import results as A, review as R
from fieldmill.operators.skew import keyed_join, previous_values, row_index
from fieldmill.plans import process as P
from fieldmill.sources import files
from fieldmill.streaming import jobs as S
from workload.all import QUERIES


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_row_index_of_a_hot_group(spark):
    d = spark.range(2000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(7).alias("k"),
                                 ((F.col("id") * 7919) % 100003).alias("o"))
    got = row_index(d, ["k"], F.floor(F.col("o") / 1000), ["o"], "i").select("k", "o", "i")
    want = d.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("o")) - 1)
    assert rows(got) == rows(want)


def test_previous_values_cross_buckets(spark):
    d = spark.range(1500).select((F.col("id") % 4).alias("k"), F.col("id").alias("o"), F.when(
        F.col("id") % 5 == 0, F.col("id").cast("string")).alias("v"))
    got = previous_values(d, ["k"], F.floor(F.col("o") / 37), ["o"], ["v"])
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    assert rows(got) == rows(d.withColumn("prev_v", F.last("v", ignorenulls=True).over(w)))


def test_salted_join_equals_plain_join(spark):
    big = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "k long, v string")
    assert rows(keyed_join(big, small, ["k"]).select("k", "id", "v")) == rows(
        keyed_join(big, small, ["k"], spread=F.col("id"), salts=5).select("k", "id", "v"))


def test_quota_equals_one_by_one_simulation(spark):
    rng = random.Random(5)
    base, data = datetime(2024, 1, 1), []
    for i in range(1200):
        hot = rng.random() < 0.4
        data.append((i, base + timedelta(seconds=rng.randrange(90) if hot else rng.randrange(3 * 86400)),
                     rng.choice("ab"), "m"))
    for per_minute, per_day in ((2, 3), (3, 40), (0, 25), (4, 0), (0, 0)):
        used, want = defaultdict(int), {}
        for i, ts, p, m in sorted(data, key=lambda r: (r[1], r[0])):
            minute, day = (p, m, ts.replace(second=0)), (p, m, ts.date())
            if 0 < per_minute <= used[minute]:
                want[i] = "minute"
            elif 0 < per_day <= used[day]:
                want[i] = "day"
            else:
                used[minute] += 1
                used[day] += 1
                want[i] = None
        d = spark.createDataFrame(data, "request_id long, ts timestamp, provider string, model string")
        got = {r.request_id: r.refused_by for r in A.quota_admission(d, per_minute, per_day).collect()}
        assert got == want


def test_review_confidence_equals_the_ratio(spark):
    pairs = [("abcd", "bcde"), ("Invoice 12", "invoice  12"), ("", "x"), ("same", "same"), ("Klang yard", "klang  Yards")]
    d = spark.createDataFrame([(i, 0.93, a, b, True) for i, (a, b) in enumerate(pairs)] + [(99, 0.93, "q", "q", False)],
                              "field_id int, confidence double, extracted_value string, display_value string, corrected boolean")
    got = {r.field_id: r.review_confidence for r in R.review_confidence(d).collect()}
    ratio = round(SequenceMatcher(None, "klang yard", "klang yards").ratio(), 4)
    assert got == {0: 0.75, 1: 0.98, 2: 0.0, 3: 1.0, 4: ratio, 99: 0.93}


def test_results_do_not_depend_on_partitioning(spark):
    before = {n: rows(QUERIES[n](spark, SMALL)) for n in ("apply_corrections", "reviewer_briefing", "template_order")}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name, want in before.items():
            assert rows(QUERIES[name](spark, SMALL)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_free_text_is_one_narrow_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(
        "doc_id", F.col("text").alias("raw_text"), F.lit("plain_text").alias("parser_type"),
        F.lit("auto_detect").alias("extraction_mode"), F.lit(None).cast("string").alias("document_type_key"))
    big = P.process_text(docs, Catalogue.bundled())
    plan = big._jdf.queryExecution().executedPlan().toString()
    # the only exchanges: dealing out a small file, and the broadcast catalogue
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    assert plan.count("BroadcastHashJoin") == 1


def test_lists_are_limited_before_the_shuffle(spark):
    plan = QUERIES["reviewer_briefing"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    plan = QUERIES["csv_profile_text"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_a_document_of_many_pages_is_one_row(spark):
    from fieldmill.operators.ingest import assemble_pages
    pages = spark.range(25_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("page_no"), F.lit("t").alias("text"))
    (row,) = assemble_pages(pages).collect()
    assert row.raw_text.count("--- Page ") == 25_000 and row.raw_text.endswith("--- Page 24999 ---\nt")


def test_replacing_sink(spark, tmp_path):
    path = str(tmp_path / "fields")
    first = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "doc_id long, v string")
    docs = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc_id long")
    files.write_replacing(path, first, docs(1, 2, 3), buckets=4)
    second = spark.createDataFrame([(1, "z")], "doc_id long, v string")
    for _ in range(2):  # a rerun changes nothing
        files.write_replacing(path, second, docs(1, 3), buckets=4)
        assert rows(files.read_fields(path, spark).select("doc_id", "v")) == [(1, "z"), (2, "c")]


def test_latest_values_stream_in_batches_and_reruns(spark, tmp_path):
    path = tmp_path / "latest"
    write = S.keep_latest(str(path))
    schema = "field_id long, corrected_value string, corrected_at timestamp, correction_id long"
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    one = spark.createDataFrame([(1, "a", at(1), 1), (1, "b", at(5), 2), (2, "c", at(2), 3)], schema)
    two = spark.createDataFrame([(1, "old", at(3), 4), (3, "d", at(9), 5)], schema)
    write(one, 0)
    names = {f: f.stat().st_mtime_ns for f in (path / "version=0").iterdir()}
    write(two, 1)
    write(two, 1)  # a batch that is run again
    assert {f: f.stat().st_mtime_ns for f in (path / "version=0").iterdir()} == names
    got = lambda p: rows(S.read_latest(spark, str(p)).select("field_id", "corrected_value"))
    assert got(path) == [(1, "b"), (2, "c"), (3, "d")]
    assert S.compact_latest(spark, str(path), str(tmp_path / "compact")) == 1
    assert got(tmp_path / "compact") == got(path)


def test_a_hot_field_is_spread_by_days(spark):
    fields = spark.createDataFrame([(7, 1, "a", "x", None, "string", False, False, True), (8, 1, "b", "y", None, "string", False, False, True)],
                                   "field_id long, doc_id long, field_name string, extracted_value string, standard_field_key string, "
                                   "data_type string, required boolean, accepted boolean, needs_review boolean")
    data = [(i, datetime(2024, 1, 1) + timedelta(hours=7 * i), "correct", 7 if i % 5 else 8 + i % 2, None, f"v{i}", "u") for i in range(200)]
    actions = spark.createDataFrame(data, "action_id long, ts timestamp, kind string, field_id long, field_name string, value string, actor string")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        folded = R.fold_actions(fields, actions)
        plan = folded._jdf.queryExecution().executedPlan().toString()
        exchanges = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
        # the actions are dealt out by field and day; by field alone go only the fields and the distinct pairs
        assert any(re.match(r"field_id#\d+L, _bucket#\d+, ", e) for e in exchanges)
        assert "Window" in plan and not re.search(r"Window(?:(?!Window).)*?Exchange hashpartitioning\(field_id#\d+L, \d+\)", plan.split("SortMergeJoin")[0], re.S)
        got = {r.action_id: (r.old_value, r.new_value, r.outcome) for r in folded.collect()}
    finally:
        for key in settings:
            spark.conf.unset(key)
    now = {7: "x", 8: "y"}
    for i, _, _, field_id, _, value, _ in data:
        if field_id in now:
            assert got[i] == (now[field_id], value, "applied")
            now[field_id] = value
        else:
            assert got[i][2] == "refused"


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    make = lambda a, b: spark.range(a, b).selectExpr(
        "id as doc_id", "concat('Invoice\\nInvoice No: ', id) as raw_text", "'plain_text' as parser_type",
        "'auto_detect' as extraction_mode", "cast(null as string) as document_type_key")
    for a, b in ((0, 5), (5, 9)):
        make(a, b).write.mode("append").parquet(source)
        stream = spark.readStream.schema(make(0, 1).schema).parquet(source)
        S.run_available(S.extract_stream(stream, Catalogue.bundled()), "parquet", state, out)
    batch = P.field_rows(P.process_text(make(0, 9), Catalogue.bundled()))
    assert rows(spark.read.parquet(out).select("doc_id", "field_name", "value")) == rows(
        batch.select("doc_id", "field_name", "value"))


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "b.json").write_text('{"key":"k2","fields":[{"key":"x","aliases":["y"]}]}')
    (tmp_path / "t" / "a.json").write_text('{"key":"k1","name":"One","fields":[{"key":"f","label":"F","data_type":"date",'
                                           '"required":true,"validation":{"min":1}}]}')
    c = Catalogue.from_rows(files.read_templates(spark, str(tmp_path / "t")))
    assert [t.key for t in c.templates] == ["k1", "k2"]
    assert c.templates[0].fields[0].required and c.templates[1].fields[0].label == "x"
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "n.txt").write_bytes(b"caf\xff")
    up = files.read_uploads(spark, str(tmp_path / "u"))
    from fieldmill.operators.ingest import parse_text
    r = parse_text(up).first()
    assert (r.filename, r.raw_text) == ("n.txt", "caf�")


def test_a_page_reads_only_what_follows_the_one_before(spark):
    from fieldmill.operators.analytics import search_table
    part = spark.read.parquet(f"{SMALL}/part.parquet")
    first = search_table(part, "p_partkey", "a", 5).collect()
    page = search_table(part, "p_partkey", "a", 5, after=first[-1].p_partkey)
    assert f"LessThan(p_partkey,{first[-1].p_partkey})" in page._jdf.queryExecution().executedPlan().toString()
    both = search_table(part, "p_partkey", "a", 10).collect()
    assert first + page.collect() == both


def test_entry_goes_on_without_the_training_data_packages(monkeypatch, capsys):
    import builtins

    import __spark_entry__ as entry
    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "corpus_pipeline":
            raise ImportError("no module named tokenizers")
        return real(name, *args, **kwargs)
    monkeypatch.setattr(builtins, "__import__", without)
    assert set(entry.queries()) == set(QUERIES) and "tokenizers" in capsys.readouterr().err
