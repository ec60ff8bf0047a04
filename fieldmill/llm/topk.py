"""Exact top-k inner products by histogram selection.

Queries and candidates are dealt into blocks; every pair of blocks is one row of work that scores all its pairs in numpy.
No score is kept: round by round the blocks count, per query, how many scores fall into each bin of the interval that
still can hold the k-th highest; the counts are summed over all blocks, and the interval shrinks to one bin, until the
k-th highest score itself is known. The first interval starts at the highest k-th score that one block alone has: no block has k scores
above it, so a block counts at most k bins a query, however wide the scores spread. A last pass keeps the scores above it and, of those equal to it, the smallest
candidate ids that each block needs.

Vectors become floor(scale * x) as integers. Vectors that are null or empty, or hold null or non-finite components, take no part, nor do rows
without id; only vectors of one length are multiplied with each other. Rows are told apart by a number of their own, not by their id: of
repeated ids each row is a query and a candidate, and only a query's own row is no candidate of it. Fewer candidates than k: all of them. Scores beyond
2**62 - 1, either way, are held there. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.llm.common import stored

#: Rows of a block of queries and of candidates (QUERY_ROWS * CANDIDATE_ROWS scores of 8 bytes are held at once), bins.
QUERY_ROWS = 512
CANDIDATE_ROWS = 4_096
BINS = 1_024
LIMIT = 2 ** 62 - 1
BLOCK = "dim int, blk long, n int, ids binary, rows binary, kind string, data binary"


def sound_vectors(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, row, dim, v) of the rows that take part; row: a number of their own; v in doubles."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.size(vector).alias("dim"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.coalesce((F.col("dim") > 0) & finite, F.lit(False)))


def blocks(vectors: DataFrame, queriesper_block: int, scale: int) -> DataFrame:
    """One row per block of about queriesper_block vectors of one length: ids and floor(scale * x), packed."""
    sizes = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_blocks = F.lit(1)
    for dim, n in sizes.items():
        n_blocks = F.when(F.col("dim") == dim, -(-n // queriesper_block)).otherwise(n_blocks)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        data = np.floor(np.stack(frame["v"].to_numpy()).astype(np.float64) * scale)
        kind = "<i2" if np.abs(data).max() < 2 ** 15 else "<f8"
        return pd.DataFrame({"dim": frame["dim"].iloc[:1].to_numpy(), "blk": frame["blk"].iloc[:1].to_numpy(), "n": [len(frame)],
                             "ids": [frame["id"].to_numpy().astype("<i8").tobytes()],
                             "rows": [frame["row"].to_numpy().astype("<i8").tobytes()], "kind": [kind],
                             "data": [data.astype(kind).tobytes()]})

    dealt = vectors.withColumn("blk", F.pmod(F.monotonically_increasing_id(), n_blocks.cast("long")))
    return dealt.groupBy("dim", "blk").applyInPandas(pack, BLOCK)


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as 64-bit integers."""
    bound = float(np.abs(left).max()) * float(np.abs(right).max()) * left.shape[1]
    if bound < 2.0 ** 53:
        return (left @ right.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in side], object) for side in (left, right)]
    return np.clip(whole[0] @ whole[1].T, -LIMIT, LIMIT).astype(np.int64)


def matrix(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(row[f"{side}data"], row[f"{side}kind"]).astype(np.float64)
    return np.frombuffer(row[f"{side}ids"], "<i8"), np.frombuffer(row[f"{side}rows"], "<i8"), data.reshape(row[f"{side}n"], row["dim"])


def pairs(queries: DataFrame, candidates: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Every query block with every candidate block of its length. Each side is repeated for the block numbers of the other
    and both meet on the pair of numbers: even work. Only the numbers are broadcast, one a length: Spark takes a repeated side for as
    small as its table, and would bring all repeats of the queries to the driver."""
    numbers = lambda side, name: F.broadcast(side.groupBy("dim").agg(F.max("blk").alias(name)))
    sided = lambda side, s: [F.col(c).alias(s + c) for c in ("n", "ids", "rows", "kind", "data")]
    upto = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name)))
    left = queries.join(numbers(candidates, "_last"), "dim").select(
        "dim", F.col("blk").alias("qblk"), *sided(queries, "q"), *extra, upto("_last").alias("cblk"))
    right = candidates.join(numbers(queries, "_last"), "dim").select(
        "dim", F.col("blk").alias("cblk"), *sided(candidates, "c"), upto("_last").alias("qblk"))
    return left.join(right.hint("merge"), ["dim", "qblk", "cblk"])


def scored(work: DataFrame, function, schema: str) -> DataFrame:
    """function(query rows, candidate ids, scores, own (pairs of one row), row) gives the columns of `schema` for a pair of blocks."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                (_, queries, q), (ids, candidates, c) = matrix(row, "q"), matrix(row, "c")
                columns = function(queries, ids, exact_scores(q, c), queries[:, None] == candidates[None, :], row)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

    return work.mapInArrow(run, schema)


def span(k: int):
    """For `scored`: the lowest and the highest score of a query in a block, the k-th highest (-LIMIT: fewer), and their number."""
    def measure(queries, cids, s, own, row):
        others = np.where(own, -LIMIT, s)
        at = others.shape[1] - k
        kth = np.partition(others, at, 1)[:, at] if at >= 0 else np.full(len(queries), -LIMIT)
        return queries, np.where(own, LIMIT, s).min(1), others.max(1), kth, (~own).sum(1)
    return measure


def width_of(low, high):
    """Width of the bins that cover low to high, both included."""
    return (high - low) // BINS + 1


def histogram(queries, cids, s, own, row):
    low, high = np.frombuffer(row["lows"], "<i8")[:, None], np.frombuffer(row["highs"], "<i8")[:, None]
    q, c = np.nonzero(~own & (s >= low) & (s <= high) & (low < high))
    found, n = np.unique(q * BINS + (s[q, c] - low[q, 0]) // width_of(low, high)[q, 0], return_counts=True)
    return queries[found // BINS], found % BINS, n


def selected(queries, cids, s, own, row):
    """Scores over the k-th, and the smallest ids among those equal to it, as many as are wanted."""
    kth, ties = np.frombuffer(row["lows"], "<i8")[:, None], np.frombuffer(row["highs"], "<i8")
    q, c = np.nonzero(~own & (s > kth))
    out = [(queries[q], cids[c], s[q, c])]
    equal = ~own & (s == kth)
    for i in np.flatnonzero(equal.any(1)).tolist():
        ids = np.sort(cids[equal[i]])[:ties[i]]
        out.append((np.full(len(ids), queries[i]), ids, np.full(len(ids), kth[i, 0])))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def with_numbers(queries: DataFrame, numbers: DataFrame) -> DataFrame:
    """queries with `lows` and `highs`: the two numbers of each query (query, low, high), in the order of its rows.

    Both sides are one row per query; a query without numbers gets low 0 and high -1, an empty interval.
    """
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["rows"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([row["dim"]] * len(ids), pa.int32()), pa.array([row["blk"]] * len(ids)),
                                                  pa.array(range(len(ids)), pa.int32()), pa.array(ids)], ["dim", "blk", "at", "query"])

    each = queries.select("dim", "blk", "rows").mapInArrow(unpack, "dim int, blk long, at int, query long")
    each = each.join(numbers, "query", "left").groupBy("dim", "blk").agg(F.sort_array(F.collect_list(F.struct(
        "at", F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("high", F.lit(-1)).alias("high")))).alias("_each"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            of = lambda name: pa.array([np.array([x[name] for x in r["_each"]], "<i8").tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("dim"), batch.column("blk"), of("low"), of("high")],
                                             ["dim", "blk", "lows", "highs"])

    return queries.join(each.mapInArrow(pack, "dim int, blk long, lows binary, highs binary"), ["dim", "blk"])


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_column: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row for which is_query (over the column `id`) holds."""
    vectors = stored(sound_vectors(rows, id_column, vector), "topk-vectors")
    candidates = stored(blocks(vectors, CANDIDATE_ROWS, scale), "topk-candidates")
    queries = stored(blocks(vectors.where(is_query), QUERY_ROWS, scale), "topk-queries")
    found = scored(pairs(queries, candidates), span(k), "query long, low long, high long, kth long, m long").where("m > 0")
    state = found.groupBy("query").agg(F.greatest(F.min("low"), F.max("kth")).alias("low"), F.max("high").alias("high"), F.sum("m").alias("m"))
    # want: which of the scores in the interval, from the top, is the k-th highest
    state = stored(state.select("query", "low", "high", F.least(F.lit(k), "m").cast("long").alias("want")), "topk-state")
    while state.agg(F.coalesce(F.max(F.col("high") - F.col("low")), F.lit(0)).alias("w")).first()["w"] > 0:
        work = pairs(with_numbers(queries, state.select("query", "low", "high")), candidates, ("lows", "highs"))
        counts = scored(work, histogram, "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        hit = counts.withColumn("_upto", F.sum("n").over(down)).join(state.select("query", "want"), "query").where(
            (F.col("_upto") >= F.col("want")) & (F.col("_upto") - F.col("n") < F.col("want")))
        hit = hit.select("query", "bin", (F.col("_upto") - F.col("n")).alias("_above"))
        width = F.expr(f"(high - low) div {BINS} + 1")
        low = F.col("low") + F.col("bin") * width
        state = stored(state.join(hit, "query", "left").select(
            "query", F.coalesce(low, "low").alias("low"), F.coalesce(F.least(low + width - 1, "high"), "high").alias("high"),
            (F.col("want") - F.coalesce("_above", F.lit(0))).alias("want")), "topk-state")
    last = with_numbers(queries, state.select("query", "low", F.col("want").alias("high")))
    best = scored(pairs(last, candidates, ("lows", "highs")), selected, "query long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = best.join(state.select("query"), "query", "left_semi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = vectors.where(is_query).select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return best.join(named, "query").select("query_id", "rank", "vec_id", "score")
