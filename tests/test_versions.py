"""Tables that only grow: versions of documents, counts and contents of arriving batches."""

from datetime import datetime, timedelta

from fieldmill.sources import versions as V
from fieldmill.streaming import jobs as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files(path):
    return {f: f.stat().st_mtime_ns for f in path.rglob("part-*")}


def test_documents_are_replaced_without_touching_older_files(spark, tmp_path):
    path = tmp_path / "fields"
    docs = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc_id long")
    first = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "doc_id long, v string").repartition(3)
    V.append_documents(str(path), first, docs(1, 2, 3), 1)
    before = files(path)
    assert len(before) >= 3  # several tasks write one version
    second = spark.createDataFrame([(1, "z")], "doc_id long, v string")
    for _ in range(2):  # a rerun changes nothing
        V.append_documents(str(path), second, docs(1, 3), 2)
        assert rows(V.read_documents(spark, str(path)).select("doc_id", "v")) == [(1, "z"), (2, "c")]
    assert before.items() <= files(path).items()
    new = str(tmp_path / "compact")
    assert V.compact_documents(spark, str(path), new) == 2
    assert rows(V.read_documents(spark, new).select("doc_id", "v")) == [(1, "z"), (2, "c")]
    V.append_documents(new, second.limit(0), docs(2), 3)
    assert rows(V.read_documents(spark, new).where("doc_id = 2").select("doc_id", "v")) == []


def test_no_window_is_held_back_and_late_rows_count(spark, tmp_path):
    at = lambda minute, second=0: datetime(2024, 1, 1) + timedelta(minutes=minute, seconds=second)
    frame = lambda data: spark.createDataFrame([(t, "p", "m") for t in data], "ts timestamp, provider string, model string")
    path = str(tmp_path / "counts")
    write = S.append_counts(path)
    write(frame([at(0), at(0, 30), at(5), None]), 0)
    write(frame([at(30), at(30, 1), at(5, 9)]), 1)
    for _ in range(2):  # a batch that is run again counts once
        write(frame([at(0, 59), at(31)]), 2)
    got = {(r.window_start.minute, r.request_count, r.late_requests, r.is_open) for r in S.read_counts(spark, path).collect()}
    assert got == {(0, 3, 1, False), (5, 2, 0, False), (30, 2, 0, True), (31, 1, 0, True)}


def test_copies_are_found_however_far_apart(spark, tmp_path):
    path = tmp_path / "contents"
    frame = lambda data: spark.createDataFrame(data, "ts timestamp, content_hash string")
    day = lambda n: datetime(2022, 1, 1) + timedelta(days=n)
    write = S.append_new_content(str(path))
    write(frame([(day(0), "a"), (day(0), "a"), (day(0), "b"), (day(0), None)]), 0)
    before = files(path)
    for _ in range(2):
        write(frame([(day(401), "a"), (day(401), "c")]), 1)
    write(frame([(day(900), "b"), (day(900), "c"), (day(900), "d")]), 2)
    assert rows(V.versions(spark, str(path)).select("content_hash", "version")) == [("a", 0), ("b", 0), ("c", 1), ("d", 2)]
    assert before.items() <= files(path).items()


def test_streams_go_on_from_their_checkpoint(spark, tmp_path):
    source, state, path = (str(tmp_path / n) for n in ("in", "state", "contents"))
    for a, b in ((0, 50), (25, 80)):
        spark.range(a, b).selectExpr("timestamp_seconds(id) as ts", "cast(id % 60 as string) as content_hash").write.mode("append").parquet(source)
        stream = spark.readStream.schema("ts timestamp, content_hash string").parquet(source)
        S.run_available(stream, "", state, writer=S.append_new_content(path))
    assert sorted(int(r.content_hash) for r in V.versions(spark, path).collect()) == list(range(60))
