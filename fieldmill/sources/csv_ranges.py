"""CSV files of any size, read by many tasks: every range of bytes is parsed on its own, from the quote state it begins in.

Spark's text reader deals out byte ranges and gives each its lines. Whether a line begins inside a quoted cell cannot be seen
from the line, but what a line, and so a whole range, does to that state can: it is a function from (outside, inside) to (outside,
inside). Three narrow steps follow, none of which moves the text:

1. summaries: each range is read once for both states it may begin in; they mostly agree after a few lines. One row per range: the
   state at its end and the number of rows that begin in it, for either state.
2. placed: these functions are composed along each file, which gives every range its true state and the number of its first row.
3. pieces: each range is read again from its state and cut into rows. A row that crosses the end of its range leaves its pieces
   under its number; only the ranges with such pieces are read once more, and only the pieces are shuffled.

Rows and cells are those of operators.ingest (one-cell reader): a quote opens a quoted cell only where a cell starts; CR, LF and
CRLF end rows; empty rows do not count. The rows of a batch pass through Python as Arrow arrays; only lines with a quote or with a
carriage return inside are looked at one by one. Summaries (one row of numbers for each range) and separators (one for each
file) are broadcast: the driver holds a longer list of both when it plans the scan.

Empty files: no records. A quoted cell that is never closed ends with its file, without a line feed that ends the file. Bytes that are no UTF-8 become the replacement
character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fieldmill.llm.common import stored
from fieldmill.operators.ingest import csv_rows, named_cells

SEPARATORS = ",;\t|"
#: Characters of a file's beginning that decide its separator.
SAMPLE = 4096
#: Bytes of small ranges that one task reads in turn.
TASK_BYTES = 32 << 20
QUOTED = r'"(?:[^"]++|"")*+'


class Grammar:
    """Rows of one separator, line by line."""

    def __init__(self, separator: str):
        ends = f"[{re.escape(separator)}\\r]"
        rest = f"[^{re.escape(separator)}\\r]*+"
        cell = f'(?:{QUOTED}"{rest}|(?!"){rest})'
        opened = f"{QUOTED}\\Z"
        self.from_outside = re.compile(f"(?:{cell}{ends})*+{opened}")
        self.from_inside = re.compile(f'(?:[^"]++|"")*+(?:\\Z|"{rest}{ends}(?:{cell}{ends})*+{opened})')
        any_cell = f'(?:{QUOTED}(?:"{rest}|\\Z)|(?!"){rest})'
        after = f"(?:{re.escape(separator)}{any_cell})*+"
        self.row = re.compile(any_cell + after)
        self.rest_of_row = re.compile(f'(?:[^"]++|"")*+(?:\\Z|"{rest}{after})')

    def ends_inside(self, line: str, inside: bool) -> bool:
        return bool((self.from_inside if inside else self.from_outside).match(line))

    def rows(self, text: str, inside: bool = False) -> tuple[str, list[str]]:
        """(what is left of the row that goes on, if inside; the non-empty rows that begin in the text)."""
        head, at = "", 0
        if inside:
            found = self.rest_of_row.match(text)
            head, at = found.group(), found.end() + 1
        rows = []
        while at <= len(text):
            found = self.row.match(text, at)
            if found.group():
                rows.append(found.group())
            at = found.end() + 1
        return head, rows


def lines_of(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """line, doc_id (hash of the path), path, block (where the line's range begins), in their order within each partition.

    A task reads many small ranges one after the other, so the number of tasks goes by the bytes, not by the ranges.
    """
    if range_bytes:
        spark = spark.newSession()
        spark.conf.set("spark.sql.files.maxPartitionBytes", range_bytes)
        spark.conf.set("spark.sql.files.openCostInBytes", range_bytes)
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    tasks = 0
    if range_bytes and range_bytes < TASK_BYTES:
        ranges = lines.rdd.getNumPartitions()
        tasks = max(spark.sparkContext.defaultParallelism, -(-ranges * range_bytes // TASK_BYTES))
        tasks = tasks if tasks < ranges else 0
    lines = lines.select(F.make_valid_utf8("value").alias("line"), F.xxhash64("_metadata.file_path").alias("doc_id"),
                         F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    return lines.coalesce(tasks) if tasks else lines


def stretches(keys: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(start, stop) of neighbours with equal keys."""
    n = len(keys[0])
    if n:
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        yield from zip([0, *cut.tolist()], [*cut.tolist(), n], strict=True)


class Batch:
    """The lines of one range in one batch."""

    def __init__(self, lines: pa.Array, grammar: Grammar, first: bool):
        if first and len(lines) and (lines[0].as_py() or "").startswith("﻿"):
            lines = pa.concat_arrays([pa.array([lines[0].as_py()[1:]], lines.type), lines.slice(1)])
        self.lines, self.grammar = lines, grammar
        self.bare = pc.utf8_rtrim(lines, "\r")
        self.quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
        self.full = pc.not_equal(self.bare, "").to_numpy(zero_copy_only=False)
        self.returns = np.flatnonzero(pc.match_substring(self.bare, "\r").to_numpy(zero_copy_only=False))

    def states(self, inside: bool) -> tuple[np.ndarray, bool]:
        """(whether each line begins inside a quoted cell, whether the last one ends there)."""
        begins, at = np.empty(len(self.lines), bool), 0
        for i in self.quoted.tolist():
            begins[at:i + 1] = inside
            inside = self.grammar.ends_inside(self.lines[i].as_py(), inside)
            at = i + 1
        begins[at:] = inside
        return begins, inside

    def count(self, begins: np.ndarray) -> int:
        """Rows that begin in these lines."""
        total = int((~begins & self.full).sum())
        for i in self.returns.tolist():
            total += len(self.grammar.rows(self.lines[i].as_py(), bool(begins[i]))[1]) - int(not begins[i])
        return total


def beginnings(lines: DataFrame) -> DataFrame:
    """Per file: doc_id, path, separator (the most frequent one of its first SAMPLE characters), header (text of its first row)."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done():
            text = "\n".join(held).removeprefix("﻿")
            separator = max(SEPARATORS, key=lambda s: (text[:SAMPLE].count(s), -SEPARATORS.index(s)))
            grammar, row = Grammar(separator), ""
            for line in text.split("\n"):
                row = f"{row}\n{line}" if row else line
                if not grammar.ends_inside(row, False):
                    rows = grammar.rows(row)[1]
                    if rows:
                        row = rows[0]
                        break
                    row = ""
            return pa.RecordBatch.from_pylist([{"doc_id": now[0], "path": now[1], "separator": separator, "header": row}])

        now, held, size = None, [], 0
        for batch in batches:
            keys = batch.column("doc_id").to_numpy()
            for a, b in stretches([keys]):
                here = (int(keys[a]), batch.column("path")[a].as_py())
                if here != now:
                    if now:
                        yield done()
                    now, held, size = here, [], 0
                for line in batch.column("line").slice(a, b - a):
                    # enough for the separator, and for a header that is longer than that
                    if size > SAMPLE and '"' not in held[-1] and "\n".join(held).count('"') % 2 == 0:
                        break
                    held.append(line.as_py())
                    size += len(held[-1]) + 1
        if now:
            yield done()

    return lines.where("block = 0").mapInArrow(first, "doc_id long, path string, separator string, header string")


def summaries(lines: DataFrame, separators: DataFrame) -> DataFrame:
    """Per range: doc_id, block, separator, and for a beginning outside and inside of a quoted cell the end state and the rows begun."""
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done():
            (a, n), (b, m) = totals
            return pa.RecordBatch.from_pylist([{"doc_id": now[0], "block": now[1], "separator": now[2], "out_end": a, "in_end": b,
                                                "out_rows": n, "in_rows": m}])

        now, totals, grammar = None, [], None
        for batch in batches:
            docs, blocks = batch.column("doc_id").to_numpy(), batch.column("block").to_numpy()
            for a, b in stretches([docs, blocks]):
                here = (int(docs[a]), int(blocks[a]), batch.column("separator")[a].as_py())
                begun = here != now
                if begun:
                    if now:
                        yield done()
                    now, totals, grammar = here, [(False, 0), (True, 0)], Grammar(here[2])
                part = Batch(batch.column("line").slice(a, b - a), grammar, begun and here[1] == 0)
                fresh = []
                for state, rows in totals:
                    if fresh and state == totals[0][0]:
                        fresh.append((fresh[0][0], rows + fresh[0][1] - totals[0][1]))
                        continue
                    begins, end = part.states(state)
                    fresh.append((end, rows + part.count(begins)))
                totals = fresh
        if now:
            yield done()

    tagged = lines.select("line", "doc_id", "block").join(F.broadcast(separators), "doc_id")
    return tagged.mapInArrow(summarise, "doc_id long, block long, separator string, out_end boolean, in_end boolean, out_rows long, in_rows long")


def placed(ranges: DataFrame) -> DataFrame:
    """Adds inside (the range begins in a quoted cell), ends_inside, first_row: the functions composed along each file.

    A range whose end does not depend on its beginning fixes the state; after it, every range that swaps the two states counts.
    """
    before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("out_end") == F.col("in_end")
    swaps = F.when(~fixed & F.col("out_end"), 1).otherwise(0)
    steps = ranges.withColumn("_swaps", F.coalesce(F.sum(swaps).over(before), F.lit(0)))
    state = F.coalesce(F.last(F.when(fixed, F.col("out_end")), True).over(before), F.lit(False))
    since = F.col("_swaps") - F.coalesce(F.last(F.when(fixed, F.col("_swaps")), True).over(before), F.lit(0))
    known = steps.withColumn("inside", state != (since % 2 == 1))
    known = known.withColumn("ends_inside", F.when(F.col("inside"), F.col("in_end")).otherwise(F.col("out_end")))
    rows = F.when(F.col("inside"), F.col("in_rows")).otherwise(F.col("out_rows"))
    return known.withColumn("first_row", F.coalesce(F.sum(rows).over(before), F.lit(0))).select(
        "doc_id", "block", "separator", "inside", "ends_inside", "first_row")


def pieces(lines: DataFrame, ranges: DataFrame, crossing: bool) -> DataFrame:
    """doc_id, row, block, text: whole rows of the ranges, or (crossing) the pieces of rows that do not end in their range."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple[int, str]]):
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]] * len(rows), pa.int64()), pa.array([r for r, _ in rows], pa.int64()),
                 pa.array([now[1]] * len(rows), pa.int64()), pa.array([t for _, t in rows], pa.string())], ["doc_id", "row", "block", "text"])

        def closed(text: list[str], number: int, open_end: bool) -> tuple[list[tuple[int, str]], int]:
            """The rows of lines that belong together, and the next number; goes_on says whether they continue an earlier row."""
            joined = "\n".join(text) if open_end else "\n".join(text).rstrip("\r")
            head, rows = grammar.rows(joined, goes_on) if "\r" in joined or goes_on else ("", [joined] if joined else [])
            whole = list(enumerate(rows, number))
            parts = [(number - 1, head)] if goes_on else []
            if open_end and whole:
                parts.append(whole.pop())
            return (parts if crossing else whole), number + len(rows)

        now, grammar, held, inside, goes_on, number = None, None, [], False, False, 0
        for batch in batches:
            docs, blocks = batch.column("doc_id").to_numpy(), batch.column("block").to_numpy()
            for a, b in stretches([docs, blocks]):
                here = (int(docs[a]), int(blocks[a]))
                begun = here != now
                if begun:
                    if held:
                        rows, _ = closed(held, number, inside)
                        yield out(rows)
                    inside, number = batch.column("inside")[a].as_py(), batch.column("first_row")[a].as_py()
                    now, grammar, held, goes_on = here, Grammar(batch.column("separator")[a].as_py()), [], inside
                part = Batch(batch.column("line").slice(a, b - a), grammar, begun and here[1] == 0)
                begins, inside = part.states(inside)
                after = np.concatenate([begins[1:], [inside]])
                # lines that are rows by themselves, in stretches between those that need a closer look
                alone = ~begins & ~after
                alone[part.returns] = False
                numbers, rows = np.zeros(len(alone), np.int64), []
                for x, y in stretches([alone]):
                    if alone[x]:
                        count = np.cumsum(part.full[x:y])
                        numbers[x:y] = number - 1 + count
                        number += int(count[-1])
                        continue
                    for i, line in enumerate(part.lines.slice(x, y - x).to_pylist(), x):
                        held.append(line)
                        if not after[i]:
                            more, number = closed(held, number, False)
                            rows += more
                            held, goes_on = [], False
                # one batch for each kind of lines, however often they take turns
                keep = alone & part.full
                if not crossing and keep.any():
                    texts = part.bare.filter(pa.array(keep))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(texts), now[0])), pa.array(numbers[keep]), pa.array(np.full(len(texts), now[1])), texts],
                        ["doc_id", "row", "block", "text"])
                if rows:
                    yield out(rows)
        if held:
            rows, _ = closed(held, number, inside)
            yield out(rows)

    tagged = lines.select("line", "doc_id", "block").join(F.broadcast(ranges), ["doc_id", "block"])
    if crossing:
        tagged = tagged.where("inside or ends_inside")
    return tagged.drop("ends_inside").mapInArrow(cut, "doc_id long, row long, block long, text string")


def read_csv_records(spark: SparkSession, path: str, range_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(files: doc_id, path, separator, headers; records: doc_id, record from 0, cells), as ingest.csv_records gives them.

    range_bytes: size of the ranges, where it is not the session's spark.sql.files.maxPartitionBytes.
    """
    lines = lines_of(spark, path, range_bytes)
    # both are small and asked for several times; written once, the files are read once for each
    starts = stored(beginnings(lines), "csv-beginnings")
    ranges = stored(placed(summaries(lines, starts.select("doc_id", "separator"))), "csv-ranges")
    whole = pieces(lines, ranges, False).select("doc_id", "row", "text")
    crossing = pieces(lines, ranges, True).groupBy("doc_id", "row").agg(
        F.sort_array(F.collect_list(F.struct("block", "text"))).alias("_p"))
    rows = whole.unionByName(crossing.select("doc_id", "row", F.array_join(F.transform("_p", lambda p: p["text"]), "\n").alias("text")))
    files = starts.select("doc_id", "path", "separator", cells_of(F.col("header"), F.col("separator")).alias("headers"))
    named = rows.where("row > 0").join(files.select("doc_id", "separator", "headers"), "doc_id")
    cells = named_cells(F.col("headers"), cells_of(F.col("text"), F.col("separator")))
    return files, named.select("doc_id", (F.col("row") - 1).alias("record"), cells.alias("cells"))


def cells_of(row: Column, separator: Column) -> Column:
    """The cells of the text of one row."""
    return F.coalesce(F.get(csv_rows(row, separator), F.lit(0)), F.array().cast("array<string>"))
