"""CSV files read by ranges against the same files read as one cell each."""

import os
import random

import pytest
from pyspark.sql import functions as F

from fieldmill.operators import ingest
from fieldmill.sources import csv_ranges


def written(folder):
    """Files of every separator and line end, with quotes in all places, long cells, a BOM, nothing, and a quote never closed."""
    for f in range(14):
        rnd = random.Random(f)
        sep, end = rnd.choice(",;|\t"), rnd.choice(["\n", "\r\n", "\r", "\n"])
        quoted = ["q", 'say ""hi""', "l1\nl2", "l1\r\nl2" + sep, sep + sep, "", "z" * 60 + "\n" * rnd.randrange(4)]
        plain = ["a", "bb", "é", "x y", "", 'in"side', '"x"tail"1', "w" * 30]
        cell = lambda: f'"{rnd.choice(quoted)}"' if rnd.random() < 0.2 else rnd.choice(plain) + str(rnd.randrange(99))  # noqa: B023, E731
        rows = [f"h1{sep}h2{sep}h3"] + [sep.join(cell() for _ in range(rnd.choice([1, 2, 3, 3, 3, 5]))) for _ in range(rnd.choice([0, 3, 60, 200]))]
        text = end.join(rows) + rnd.choice(["", end, end * 3])
        text = {3: text + '"never closed' + sep + "\nxx\nyy\n" * 30 + "last", 5: "﻿" + text, 6: "", 7: "\n\n" + text.replace("\n", "\r\n\r\n", 5),
                8: 'h1,"h\n2",h3\n' + '1,2,3\r4,"a\rb",6\n' * 40}.get(f, text)
        with open(f"{folder}/f{f}.csv", "w", newline="") as out:
            out.write(text)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("csv")
    written(path)
    return str(path)


@pytest.mark.parametrize("range_bytes", [None, 60, 700])
def test_ranges_give_the_records_of_the_one_cell_reader(spark, folder, range_bytes):
    uploads = spark.read.format("binaryFile").load(folder).select(
        F.col("path").alias("doc_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    parsed = ingest.parse_csv(uploads)
    name = lambda path: os.path.basename(path)
    expected = sorted((name(r.doc_id), r.record, [tuple(c) for c in r.cells]) for r in ingest.csv_records(parsed).collect())
    files, records = csv_ranges.read_csv_records(spark, folder, range_bytes)
    found = records.join(files.select("doc_id", "path"), "doc_id").collect()
    assert sorted((name(r.path), r.record, [tuple(c) for c in r.cells]) for r in found) == expected
    headers = {name(r.doc_id): list(r.headers) for r in parsed.collect()}
    given = {name(r.path): list(r.headers) for r in files.collect()}
    assert all(given.get(f, []) == h for f, h in headers.items())


def test_one_file_is_read_by_many_tasks_and_nothing_but_pieces_is_shuffled(spark, tmp_path):
    with open(tmp_path / "one.csv", "w") as out:
        out.write("a,b\n" + '1,"x\ny"\n' * 5000)
    lines = csv_ranges.lines_of(spark, str(tmp_path), 4000)
    assert lines.select("block").distinct().count() > 10
    files, records = csv_ranges.read_csv_records(spark, str(tmp_path), 4000)
    assert records.count() == 5000 and records.agg(F.max("record")).first()[0] == 4999
    starts = csv_ranges.beginnings(lines)
    ranges = csv_ranges.placed(csv_ranges.summaries(lines, starts.select("doc_id", "separator")))
    whole = csv_ranges.pieces(lines, ranges, False)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
