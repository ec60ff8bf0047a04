"""Best-fit packing of token sequences, planned on the histogram of lengths.

Each document becomes pieces of at most `capacity` tokens (only longer ones are cut). The plan is made from the counts per
length alone: lengths in descending order, each count goes into the open sequences with the least room that still fits.
Pieces then take the planned places by their rank within their length. The plan has as many rows as groups of equal
sequences, which the capacity bounds, whatever the number of documents.

Null text: empty, one piece that holds the end id. Repeated rows are packed each. Empty table: no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.llm.common import slices, stored
from fieldmill.llm.encoder import SLICE, batch_encoder

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
PLACED = "sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the ids (with the end id 0) of each whole text."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = batch_encoder(tokenizer, drops_space=True)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, ends = encoder.encode(part.column("text"))
                rows = []
                for doc_id, first, stop in zip(part.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    own = ids[first:stop].tobytes() + b"\0\0\0\0"
                    for k in range(0, len(own), 4 * capacity):
                        piece = own[k:k + 4 * capacity]
                        rows.append((doc_id, k // (4 * capacity), k // 4, len(piece) // 4, zlib.crc32(piece)))
                columns = zip(*rows, strict=True)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts: rows (length, first rank, how many, first sequence, offset in each of these sequences).

    open_room maps room to stacks of (first sequence, how many sequences); all sequences of a stack are alike.
    """
    open_room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []  # sorted
    out, made = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_room[room].pop()
                if not open_room[room]:
                    del open_room[room], rooms[at]
            else:
                room, first = capacity, made
                n = -(-left // (capacity // length))
                made += n
            fits = room // length
            full = min(n, left // fits)
            if full:
                for k in range(fits):
                    out.append((length, rank, full, first, capacity - room + k * length))
                    rank += full
                left -= full * fits
            groups = [(first, full, room - fits * length)]
            if full < n and left:  # the last ones go into one sequence, the rest stays as it was
                for k in range(left):
                    out.append((length, rank + k, 1, first + full, capacity - room + k * length))
                groups.append((first + full, 1, room - left * length))
                rank, left, full = rank + left, 0, full + 1
            groups.append((first + full, n - full, room))
            for start, size, rest in groups:
                if size and rest:
                    if rest not in open_room:
                        open_room[rest] = []
                        insort(rooms, rest)
                    open_room[rest].append((start, size))
    return out


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows with a `length` of 1 to capacity, plus sequence_id and offset.

    Ranks: the rows are dealt by ranges of length and stored; counts per stored part and length give each part its first
    rank, so no task sees all rows of a length.
    """
    spark = rows.sparkSession
    names = rows.columns
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["length", F.xxhash64(*names)]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, "packing-dealt")
    counts = stored(dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")), "packing-counts")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rules = np.array(plan(histogram, capacity), np.int64).reshape(-1, 5)
    rules = rules[np.lexsort((rules[:, 1], rules[:, 0]))]
    local = Window.partitionBy("_part", "length").orderBy(F.xxhash64(*names))
    ranked = dealt.join(bases, ["length", "_part"]).withColumn("_rank", F.col("_base") + F.row_number().over(local) - 1)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + PLACED

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.searchsorted(rules[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            rule = np.empty(len(length), np.int64)
            for one in np.unique(length):
                own = length == one
                low, high = edges[one], edges[one + 1]
                rule[own] = low + np.searchsorted(rules[low:high, 1], rank[own], side="right") - 1
            sequence = rules[rule, 3] + rank - rules[rule, 1]
            columns = [batch.column(n) for n in names] + [pa.array(sequence), pa.array(rules[rule, 4])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(take, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return packed(stored(pieces(docs, tokenizer, capacity), "packing-pieces"), capacity)  # the dealing reads them twice
