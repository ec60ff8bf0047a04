"""Near-duplicate documents by min-max hashing.

Under each permutation both the smallest and the largest value of a shingle set are kept, so `permutations` evaluations
give a signature of twice that length. Bands of `rows` signature values make keys; sets with a common key are compared on
their full sets. With the defaults (48 bands of 6 values from 144 permutations) two sets of similarity 0.8 miss each other
with a chance of about 5e-7, more similar ones with far less.

* Equal sets are one node from the start, however many documents share it; a node is named by a 128-bit print of its set.
* First every node is compared with one pivot of each of its keys (a few edges per node and key, also for hot keys), where
  sizes and sketches (a bit per signature value) allow the similarity. What this leaves out is met again in the next step.
* Then the nodes of keys whose nodes are still in different classes are joined exactly: shingles are ordered by the number of
  classes that hold them, and two sets of different classes can only reach the similarity if the first few shingles of one (its
  prefix) hold one of the first few of the other. Shingles of one class alone come first and meet nothing, so neither a large
  group of copies nor a passage that many otherwise different documents share makes all its pairs.
* Classes come from repeated smallest-label joins with pointer jumping; every round is written to the shared folder.

Null or wordless text: empty set, linked with nothing, a class of its own. Null doc_id: takes part; a class with no other
id has a null component_id, and its rows are kept. Repeated rows: same class; every row whose id is the class id is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmill.llm.common import slices, stored
from fieldmill.llm.shingles import U64, mix, set_print, shingle_sets

#: Shingle hashes that are permuted at once.
BLOCK = 1 << 14
SKETCH = ["s0", "s1", "s2", "s3"]
SIGNED = "doc_id long, row_key long, row_print long, n_shingles long, node binary, keys array<long>, s0 long, s1 long, s2 long, s3 long"


class MinMax:
    """Signatures of shingle sets: multiply-add permutations of 32-bit values."""

    def __init__(self, bands: int = 48, rows: int = 6, seed: int = 7):
        self.bands, self.rows = bands, rows
        self.permutations = -(-bands * rows // 2)
        salts = mix(np.arange(1, 2 * self.permutations + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
        self.a = (salts[::2] >> U64(32)).astype(np.uint32) | np.uint32(1)
        self.b = (salts[1::2] >> U64(32)).astype(np.uint32)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """The minimum of every permutation, then the maximum of every permutation."""
        x = (hashes >> U64(32)).astype(np.uint32)
        low = np.full(self.permutations, 0xFFFFFFFF, np.uint32)
        high = np.zeros(self.permutations, np.uint32)
        for k in range(0, len(x), BLOCK):
            values = x[None, k:k + BLOCK] * self.a[:, None]
            values += self.b[:, None]
            np.minimum(low, values.min(1), out=low)
            np.maximum(high, values.max(1), out=high)
        return np.concatenate([low, high])

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """One 64-bit key per band of each signature; a band takes values of different permutations."""
        values = signatures[:, :self.bands * self.rows].reshape(len(signatures), self.bands, self.rows).astype(U64)
        with np.errstate(over="ignore"):
            key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=U64), values.shape[:2]).copy()
            for k in range(self.rows):
                key = mix(key * U64(0x9E3779B97F4A7C15) + values[:, :, k])
        return key.view(np.int64)

    def sketches(self, signatures: np.ndarray) -> np.ndarray:
        """Four 64-bit numbers: one bit of each of the first 256 signature values."""
        values = signatures[:, :256].astype(U64)
        with np.errstate(over="ignore"):
            bits = mix(values + np.arange(values.shape[1], dtype=U64) * U64(0x9E3779B97F4A7C15)) & U64(1)
        packed = np.zeros((len(bits), 4), U64)
        for k in range(bits.shape[1]):
            packed[:, k // 64] |= bits[:, k] << U64(k % 64)
        return packed.view(np.int64)

    def most_different(self, percent: int) -> int:
        """Bits in which two sketches of sets of this similarity differ at most, but for one pair in about ten million."""
        n = min(256, 2 * self.permutations)
        share = (1 - percent / 100) / 2
        return math.ceil(n * share + 5.2 * math.sqrt(n * share * (1 - share)))


def signed(docs: DataFrame, size: int, hasher: MinMax) -> DataFrame:
    """doc_id, row_key, row_print, n_shingles, node (print of the set, null if empty), keys (none if empty), sketch."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = shingle_sets(part.column("text"), size)
                signatures = np.stack([hasher.signature(s) for s in sets])
                keys, sketches = hasher.keys(signatures), hasher.sketches(signatures)
                full = np.array([len(s) > 0 for s in sets])
                ends = np.concatenate([[0], np.cumsum(full * hasher.bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row_key"), part.column("row_print"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([set_print(s) for s in sets], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[full].ravel())),
                     *[pa.array(np.ascontiguousarray(sketches[:, k])) for k in range(4)]],
                    ["doc_id", "row_key", "row_print", "n_shingles", "node", "keys", *SKETCH])

    return keyed(docs).mapInArrow(sign, SIGNED)


def row_keys() -> list:
    """128 bits that name a row by doc_id and text, as two numbers."""
    doc_id = F.col("doc_id").cast("long")
    return [F.xxhash64(doc_id, "text").alias("row_key"), F.xxhash64(F.lit(1), "text", doc_id).alias("row_print")]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(), "text")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, n, hashes) of the wanted (node, row_key), worked out again from the texts."""
    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = shingle_sets(part.column("text"), size)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_print(s) for s in sets], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["node", "hashes"])

    # a merge join at every size: the plan, and what it moves per row, stays the same when `wanted` outgrows a broadcast
    rows = keyed(docs).join(wanted.select("row_key").hint("merge"), "row_key", "left_semi").select("text")
    found = rows.mapInArrow(again, "node binary, hashes array<long>")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("_ha"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("_hb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("_ha", "_hb"))
    return both.select("a", "b", common.alias("_c"), (F.size("_ha") + F.size("_hb")).alias("_t")).where(
        F.lit(100) * F.col("_c") >= F.lit(percent) * (F.col("_t") - F.col("_c"))).select("a", "b")


def prefix_pairs(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different roots that may have the similarity; every pair that has it is among them.

    apart: node, root. In one order of all shingles, a set of n and one of at least as many that have the similarity share one of the
    first n - ceil(2 t n / (1 + t)) + 1 of the smaller and n - ceil(t n) + 1 of the larger; at the first such one, what is left
    of both must be enough. Only shingles that several roots hold are counted, joined and listed; all others stand before them.
    """
    t, whole = F.lit(percent), F.lit(100 + percent)
    held = stored(apart.join(sets, "node").select("node", "root", F.size("hashes").alias("n"), F.explode("hashes").alias("token")), "minmax-held")
    spread = held.select("token", "root").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("_roots")).where("_roots > 1")
    listed = held.join(spread, "token").groupBy("node", "root", "n").agg(F.sort_array(F.collect_list(F.struct("_roots", "token"))).alias("_tokens"))
    alone = F.col("n") - F.size("_tokens")
    longest = F.col("n") - F.ceil(t * F.col("n") / 100) + 1
    listed = listed.where(alone < longest).select("node", "root", "n", alone.alias("_alone"), F.posexplode(
        F.slice("_tokens", F.lit(1), (longest - alone).cast("int"))).alias("_i", "_t"))
    tokens = stored(listed.select("node", "root", "n", (F.col("_alone") + F.col("_i")).alias("place"), F.col("_t.token").alias("token")), "minmax-prefix")
    short = tokens.where(F.col("place") < F.col("n") - F.ceil(2 * t * F.col("n") / whole) + 1)
    small = short.select("token", *[F.col(c).alias(f"_{c}") for c in ("node", "root", "n", "place")])
    smaller = F.struct("_n", "_node") < F.struct("n", "node")
    enough = F.least(F.col("n") - F.col("place"), F.col("_n") - F.col("_place")) * whole >= t * (F.col("n") + F.col("_n"))
    pairs = tokens.join(small, "token").where(
        (F.col("root") != F.col("_root")) & smaller & (100 * F.col("_n") >= t * F.col("n")) & enough)
    return pairs.select(F.col("_node").alias("a"), F.col("node").alias("b")).distinct()


def classes(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link: root is the smallest node of its class.

    Each round takes the smallest label among a node and its neighbours, then the label of that label; hot nodes are
    reduced by partial aggregation before the shuffle.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "class-links")
    label = stored(both.groupBy("a").agg(F.min("b").alias("_m")).select(
        F.col("a").alias("node"), F.least("a", "_m").alias("root")), "class-labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("_m"))
        step = label.join(near, label["node"] == near["a"]).select("node", "root", F.least("root", "_m").alias("_low"))
        jump = label.select(F.col("node").alias("_low"), F.col("root").alias("_far"))
        fresh = stored(step.join(jump, "_low", "left").select(
            "node", F.col("root").alias("_was"), F.least("_low", "_far").alias("root")), "class-labels")
        label = fresh.select("node", "root")
        if fresh.where("_was <> root").isEmpty():
            return label


def rooted(docs: DataFrame, size: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(every row: doc_id, row_key, n_shingles, node; every node: node, least doc_id, least row_key, root of its class)."""
    hasher = MinMax(bands, rows)
    every = stored(signed(docs, size, hasher), "minmax-signed")
    named = every.where("node is not null").groupBy("node").agg(
        F.min("row_key").alias("row_key"), F.min("doc_id").alias("least"))
    named = stored(named, "minmax-nodes")
    nodes = every.where("node is not null").select("node", "row_key", "n_shingles", "keys", *SKETCH).join(
        named.select("node", "row_key"), ["node", "row_key"], "left_semi").dropDuplicates(["node"])
    nodes = stored(nodes, "minmax-distinct")
    banded = nodes.select("node", "n_shingles", F.explode("keys").alias("key"))
    often = banded.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    shared = stored(banded.join(often, "key"), "minmax-shared")
    # the pivot of a key is its node that meets the most others: the text that copies were made of, rather than one of them
    degree = shared.groupBy("node").agg(F.sum("_n").alias("_degree"))
    pivots = shared.select("node", "key").join(degree, "node").groupBy("key").agg(F.max_by("node", F.struct("_degree", "node")).alias("pivot"))
    sized = F.lit(100) * F.least("n_shingles", "_nb") >= F.lit(percent) * F.greatest("n_shingles", "_nb")

    # one pivot for each key
    other = nodes.select(F.col("node").alias("pivot"), F.col("n_shingles").alias("_nb"), *[F.col(c).alias(f"_{c}") for c in SKETCH])
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in SKETCH), F.lit(0))
    stars = shared.select("node", "key").join(pivots, "key").where("node <> pivot").select("node", "pivot").distinct().join(nodes.select("node", "n_shingles", *SKETCH), "node")
    stars = stars.join(other, "pivot").where(sized & (differ <= hasher.most_different(percent)))
    stars = stored(stars.select(F.col("node").alias("a"), F.col("pivot").alias("b")), "minmax-stars")
    touched = shared.select("node").distinct().join(named, "node").select("node", "row_key")
    sets = stored(sets_of(docs, touched, size), "minmax-sets")
    links = stored(verified(stars, sets, percent), "minmax-links")
    label = classes(links)

    # nodes of one key that are still apart
    marked = shared.join(label, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    split = marked.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high")
    apart = stored(marked.join(split.select("key"), "key", "left_semi").select("node", "root").distinct(), "minmax-apart")
    more = stored(verified(prefix_pairs(apart, sets, percent), sets, percent), "minmax-more")
    if not more.isEmpty():
        label = classes(links.union(more))

    return every, stored(named.join(label, "node", "left").select(
        "node", "least", "row_key", F.coalesce("root", "node").alias("root")), "minmax-rooted")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 48, rows: int = 6) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    every, root = rooted(docs, size, percent, bands, rows)
    least = root.groupBy("root").agg(F.min("least").alias("_component"))
    member = stored(root.join(least, "root").select("node", "_component"), "minmax-member")
    out = every.select("doc_id", "n_shingles", "node").join(member, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("_component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 48, rows: int = 6) -> DataFrame:
    """docs with one document of each class: the one of smallest doc_id (nulls last); columns as they are.

    Documents with an empty set all stay. Of rows repeated with id and text one stays.
    """
    every, root = rooted(docs, size, percent, bands, rows)
    key = ["row_key", "row_print"]
    times = every.where("node is not null").groupBy("node", "doc_id", *key).agg(F.count(F.lit(1)).alias("_n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", *key, "_n")).alias("_first")
    best = times.join(root.select("node", "root"), "node").groupBy("root").agg(first).select(*[f"_first.{c}" for c in key], F.expr("_first._n > 1").alias("_many"))
    empty = every.where("node is null").select(*key).distinct().withColumn("_many", F.lit(False))
    wanted = stored(best.union(empty), "minmax-best")
    # the row travels as a struct, so that its columns may have any names
    rows_in = docs.select(*row_keys(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).join(wanted, key)
    once = rows_in.where("_many").dropDuplicates(key)
    return rows_in.where("not _many").unionByName(once).select("_row.*")
