"""The prefix trie of all conversations: what they share, node by node.

A conversation is a path of turns; every distinct beginning of a conversation is a node. The nodes and what is said of their
subtrees come from balanced parentheses, built shard by shard:

* A turn is named by 128 bits of its role and text, a beginning by position-dependent sums of these, so texts are dropped
  before the first shuffle. Equal conversations become one path with a count, however many there are; their ids are
  hashed in pieces of ID_RANGE numbers that are put in order afterwards.
* Paths are dealt out in ranges of their order (depth first); a hot first turn spreads over many shards.
* In a shard a path opens the nodes that the one before lacks and closes those it lacks itself. The excess of opening over closing
  parentheses is kept in blocks with a tree of their minima, by which find_close finds the end of every subtree. Then counts of
  "()" pairs give leaves, and differences of cumulative arrays give members and savings; smallest members come from range minima.
* Neighbouring shards share a spine: the beginnings that the last path of one and the first path of the next have in common. Each
  shard sees these two paths, marks its spine nodes, and leaves what the earlier shard has counted; their parts are added up.

Null conv_id: left out, as such rows belong to no conversation. Null role or text: empty. Turns with one number stand in the order
of their hashes; repeated rows are turns of their own. No conversations: no nodes, not even a root. Other columns are not read.
One conversation's turns, 24 bytes each, and one shard's paths are held by a task at once, never texts or a whole hot group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.llm.common import stored
from fieldmill.llm.shingles import U64, mix

#: Turns for which one shard is made; ids whose decimal numbers are joined in one piece; excess values in a block.
SHARD_TURNS = 50_000
ID_RANGE = 4096
BLOCK = 64
TURNS = "array<struct<k1:long,k2:long,chars:long>>"
NODE = ["depth", "k1", "k2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id, turns (by turn, null first): of each turn two hashes of role and text, and the code points of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn"), F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit("2"), text, role).alias("k2"),
                 F.length(text).cast("long").alias("chars")).alias("_t"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_t"))
    return listed.select("conv_id", F.transform("_t", lambda t: F.struct(t["k1"].alias("k1"), t["k2"].alias("k2"), t["chars"].alias("chars"))).alias("turns"))


def with_shared_openings(convs: DataFrame) -> DataFrame:
    """conv_id, turns: the first h turns come from the conversation whose number ends in 00, h the crc32 of the decimal conv_id, modulo 6.

    All of its turns if it has fewer, none if it is absent; the conversation's own turns follow from its own place h on.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    base = F.expr("conv_id - conv_id % 100")
    openings = convs.where("conv_id % 100 = 0").select(F.col("conv_id").alias("_base"), F.slice("turns", 1, 5).alias("_opening"))
    both = convs.select("conv_id", "turns", base.alias("_base"), h.alias("_h")).join(openings, "_base", "left")
    own = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return both.select("conv_id", F.concat(F.coalesce(F.slice("_opening", F.lit(1), F.col("_h")), F.array().cast(TURNS)), own).alias("turns"))


def keys_of(convs: DataFrame) -> DataFrame:
    """conv_id, path (two numbers for each beginning, in turn), chars, and the last beginning: depth, k1, k2."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column("turns")
            sizes = turns.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            flat = turns.flatten()
            place = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)
            path = np.zeros((ends[-1], 2), U64)
            with np.errstate(over="ignore"):
                for k, odd in ((0, 0x9E3779B97F4A7C15), (1, 0xD6E8FEB86659FD93)):
                    turn = flat.field(k).to_numpy(zero_copy_only=False).view(U64)
                    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(mix(turn) + (place.astype(U64) + U64(1)) * U64(odd)), dtype=U64)])
                    path[:, k] = sums[1:] - np.repeat(sums[ends[:-1]], sizes)
            last = np.zeros((len(sizes), 2), U64)
            last[sizes > 0] = path[ends[1:][sizes > 0] - 1]
            path, last = path.view(np.int64), last.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.ListArray.from_arrays(pa.array((ends * 2).astype(np.int32)), pa.array(path.ravel())),
                 pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat.field(2)), pa.array(sizes),
                 pa.array(np.ascontiguousarray(last[:, 0])), pa.array(np.ascontiguousarray(last[:, 1]))], ["conv_id", "path", "chars", *NODE])

    return convs.mapInArrow(keys, "conv_id long, path array<long>, chars array<long>, depth long, k1 long, k2 long")


def distinct_paths(keyed: DataFrame) -> DataFrame:
    """path, chars, n (conversations that are this path), least (smallest conv_id), ends (sha256 of their ids, ascending)."""
    pieces = keyed.groupBy(*NODE, F.floor(F.col("conv_id") / ID_RANGE).alias("piece")).agg(
        F.sort_array(F.collect_list("conv_id")).alias("_ids"), F.first("path").alias("path"), F.first("chars").alias("chars"))
    pieces = pieces.select(*NODE, "piece", F.size("_ids").cast("long").alias("n"), F.get("_ids", F.lit(0)).alias("least"),
                           F.array_join("_ids", ",").alias("ids"), "path", "chars")
    ordered = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done():
            return pa.RecordBatch.from_arrays([*row, *(pa.array([v]) for v in (n, least, digest.hexdigest()))], ["path", "chars", "n", "least", "ends"])

        row = key = digest = None
        n = least = 0
        for batch in batches:
            closed: list[tuple[int, int, int, str]] = []
            keys = list(zip(*(batch.column(c).to_pylist() for c in NODE), strict=True))
            ids, counts, leasts = (batch.column(c).to_pylist() for c in ("ids", "n", "least"))
            first = None
            for i, now in enumerate(keys):
                if now == key:
                    digest.update(b"," + ids[i].encode())
                    n += counts[i]
                    continue
                if key is not None:
                    if first is None:
                        yield done()
                    else:
                        closed.append((first, n, least, digest.hexdigest()))
                key, first, n, least, digest = now, i, counts[i], leasts[i], hashlib.sha256(ids[i].encode())
            if closed:
                at = pa.array([c[0] for c in closed])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("path").take(at), batch.column("chars").take(at), *(pa.array([c[k] for c in closed]) for k in (1, 2, 3))],
                    ["path", "chars", "n", "least", "ends"])
            if first is not None:
                row = [batch.column(c).take(pa.array([first])) for c in ("path", "chars")]
        if key is not None:
            yield done()

    return ordered.mapInArrow(joined, "path array<long>, chars array<long>, n long, least long, ends string")


class Excess:
    """The excess of a balanced sequence in blocks, with a tree of the blocks' minima."""

    def __init__(self, bits: np.ndarray, block: int = BLOCK):
        self.block = block
        self.values = np.cumsum(2 * bits.astype(np.int64) - 1)
        n = -(-len(bits) // block)
        padded = np.full(n * block, np.iinfo(np.int64).max)
        padded[:len(bits)] = self.values
        self.width = 1 << max(n - 1, 0).bit_length()
        self.low = np.full(2 * self.width, np.iinfo(np.int64).max)
        self.low[self.width:self.width + n] = padded.reshape(n, block).min(1)
        for k in range(self.width.bit_length() - 2, -1, -1):
            at = np.arange(1 << k, 2 << k)
            self.low[at] = np.minimum(self.low[2 * at], self.low[2 * at + 1])
        self.padded = padded

    def scan(self, at: np.ndarray, below: np.ndarray, out: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Writes for those whose block has one from `at` on the first place with less than `below`; which of `who` are left."""
        stop = (at // self.block + 1) * self.block
        live = np.arange(len(at))
        lost = []
        while len(live):
            hit = self.padded[at[live]] < below[live]
            out[who[live[hit]]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            over = at[live] == stop[live]
            lost.append(live[over])
            live = live[~over]
        return np.concatenate(lost) if lost else live

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """For each opening parenthesis the place of the closing one: the first with a smaller excess."""
        out = np.zeros(len(opens), np.int64)
        below = self.values[opens]
        inside = opens + 1
        start = np.flatnonzero(inside % self.block != 0)
        left = np.concatenate([np.flatnonzero(inside % self.block == 0), start[self.scan(inside[start], below[start], out, start)]])
        if not len(left):
            return out
        # up to the first subtree of later blocks with a small enough minimum, then down to its first such block
        node, want = self.width + opens[left] // self.block, below[left]
        up = np.ones(len(left), bool)
        while up.any():
            k = np.flatnonzero(up)
            right = node[k] | 1
            found = (node[k] & 1 == 0) & (self.low[right] < want[k])
            node[k] = np.where(found, right, node[k] >> 1)
            up[k] = ~found
        while True:
            k = np.flatnonzero(node < self.width)
            if not len(k):
                break
            child = 2 * node[k]
            node[k] = np.where(self.low[child] < want[k], child, child + 1)
        self.scan((node - self.width) * self.block, want, out, left)
        return out


class RangeMinima:
    """The smallest of any range, from the minima of ranges of lengths 1, 2, 4, ..."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def smallest(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        level = np.frexp((stop - first).astype(float))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][stop[at] - (1 << int(k))])
        return out


SHARD_NODES = ("shard int, depth long, k1 long, k2 long, parent_k1 long, parent_k2 long, shared boolean, parent_shared boolean, conv_id long, "
               "parent_conv_id long, n_convs long, n_children long, n_leaves long, gross long, owned long, ends string")


def common_beginning(a: np.ndarray, b: np.ndarray) -> int:
    """How many beginnings two paths have in common."""
    n = min(len(a), len(b))
    return int((a[:n] == b[:n]).all(1).sum())


def shard_nodes(table: pa.Table) -> pa.Table:
    """The nodes of one shard; rows of kind -1 and 1 are the last path of the shard before and the first path of the one after."""
    table = table.combine_chunks()
    shard, kind = table.column("shard")[0].as_py(), table.column("kind").to_numpy()
    paths = [np.asarray(p, np.int64).reshape(-1, 2) for p in
             (table.column("path").chunk(0).slice(i, 1).flatten().to_numpy() for i in range(len(kind)))]
    before, after = ([paths[i] for i in np.flatnonzero(kind == k)] for k in (-1, 1))
    sortable = lambda p: (p.view(U64) ^ U64(1 << 63)).astype(">u8").tobytes()
    rows = sorted(np.flatnonzero(kind == 0).tolist(), key=lambda i: sortable(paths[i]))
    sizes = np.array([len(paths[i]) for i in rows], np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate([paths[i] for i in rows])
    chars = table.column("chars").chunk(0).take(pa.array(rows)).flatten().to_numpy().astype(np.int64)

    # a beginning is new in a path if the path before has another, or none, at that place
    row = np.repeat(np.arange(len(rows)), sizes)
    place = np.arange(ends[-1]) - ends[row]
    has = (row > 0) & (place < np.concatenate([[0], sizes[:-1]])[row])
    earlier = np.where(has, ends[np.maximum(row - 1, 0)] + place, 0)
    new = ~(has & (flat[earlier] == flat).all(1))
    kept = sizes - np.bincount(row, weights=new, minlength=len(rows)).astype(np.int64)
    closes = np.concatenate([[0], sizes[:-1]]) - kept
    closes[0] = 0
    counts = np.stack([closes, sizes - kept], 1).ravel()
    bits = np.concatenate([[True], np.repeat(np.tile([False, True], len(rows)), counts), np.zeros(sizes[-1] + 1, bool)])

    opens = np.flatnonzero(bits)
    excess = Excess(bits)
    close = excess.find_close(opens)
    depth = excess.values[opens] - 1
    n = len(opens)
    opened = np.cumsum(bits)
    first, stop = opened[opens] - 1, opened[close]
    key = np.concatenate([np.zeros((1, 2), np.int64), flat[new]])
    cost = np.concatenate([[0], chars[new]])
    last = np.cumsum(sizes - kept)  # the node in which each path ends: its last new one, or the root
    weight, least, ends_of = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    weight[last] = table.column("n").to_numpy()[rows]
    least[last] = table.column("least").to_numpy()[rows]
    ends_of[last] = rows

    order = np.argsort(depth * n + np.arange(n), kind="stable")
    ranked = (depth * n + np.arange(n))[order]
    parent = order[np.maximum(np.searchsorted(ranked, (depth - 1) * n + np.arange(n)) - 1, 0)]
    parent[0] = 0
    # spines: what this shard has in common with the one before (counted there) and with the one after
    first_path, last_path = flat[:sizes[0]], flat[len(flat) - sizes[-1]:]
    low = common_beginning(before[0], first_path) if before else -1
    high = common_beginning(after[0], last_path) if after else -1
    owned, shared = np.ones(n, bool), np.zeros(n, bool)
    owned[:low + 1] = False
    shared[:low + 1] = True
    at = n - 1
    while high >= 0:
        if depth[at] <= high:
            shared[at] = True
        if at == 0:
            break
        at = int(parent[at])

    def within(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[stop] - sums[first]

    pairs = np.zeros(len(bits) + 1, np.int64)
    leaf = bits[:-1] & ~bits[1:]
    if high == sizes[-1]:
        leaf[opens[-1]] = False  # the next shard goes on below it
    np.cumsum(leaf, out=pairs[1:-1])
    pairs[-1] = pairs[-2]
    members = within(weight)
    smallest = RangeMinima(least).smallest(first, stop)
    children = np.bincount(parent[1:], weights=owned[1:], minlength=n).astype(np.int64)
    of_parent = pa.array(smallest[parent], mask=(np.arange(n) == 0) | shared[parent])
    digests = table.column("ends").take(pa.array(np.where(ends_of < 0, 0, ends_of)))
    digests = pa.compute.if_else(pa.array(ends_of >= 0), digests, pa.scalar(None, pa.string()))
    columns = [pa.array(np.full(n, shard, np.int32)), depth, key[:, 0], key[:, 1], key[parent, 0], key[parent, 1], shared,
               shared[parent] & (np.arange(n) > 0), smallest, of_parent, members, children, pairs[close + 1] - pairs[opens],
               within(members * cost), within(owned * cost), digests]
    return pa.table([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(np.ascontiguousarray(c)) for c in columns],
                    names=[part.strip().split(" ")[0] for part in SHARD_NODES.split(",")])


def prefix_trie(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of convs (conv_id, turns): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (code points that need not be stored or read twice, in the subtree), ends_sha256."""
    spark = convs.sparkSession
    paths = stored(distinct_paths(keys_of(convs)), "trie-paths")
    turns = paths.agg(F.sum(F.size("chars") + 1).alias("n")).first()["n"] or 0
    shards = max(turns // shard_turns + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(paths.repartitionByRange(shards, "path").withColumn("shard", F.spark_partition_id()), "trie-shards")

    # one row per shard: its first and last path, handed to its neighbours
    edges = dealt.groupBy("shard").agg(F.min("path").alias("_first"), F.max("path").alias("_last"))
    turn = Window.orderBy("shard")
    edges = edges.select("shard", F.lag("_last").over(turn).alias("_before"), F.lead("_first").over(turn).alias("_after"))
    empty = [F.array().cast("array<long>").alias("chars"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("least"),
             F.lit("").alias("ends")]
    own = dealt.select("shard", F.lit(0).alias("kind"), "path", "chars", "n", "least", "ends")
    around = edges.select("shard", F.explode(F.array(
        F.struct(F.lit(-1).alias("kind"), F.col("_before").alias("path")),
        F.struct(F.lit(1).alias("kind"), F.col("_after").alias("path")))).alias("_e")).where("_e.path is not null").select("shard", "_e.kind", "_e.path", *empty)
    nodes = stored(own.union(around).groupBy("shard").applyInArrow(shard_nodes, SHARD_NODES), "trie-nodes")

    spine = nodes.where("shared")
    sums = ["n_convs", "n_children", "n_leaves", "gross", "owned"]
    merged = stored(spine.groupBy(*NODE).agg(
        F.min("shard").alias("shard"), F.first("parent_k1").alias("parent_k1"), F.first("parent_k2").alias("parent_k2"),
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums], F.max("ends").alias("ends")), "trie-spine")
    # a spine node as each of its shards names it, so that the children of a hot one are joined shard by shard
    above = spine.select("shard", *NODE).join(merged.select(*NODE, "conv_id"), NODE).select(
        "shard", (F.col("depth") + 1).alias("depth"), F.col("k1").alias("parent_k1"), F.col("k2").alias("parent_k2"), F.col("conv_id").alias("parent_conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "gross", "owned", "ends"]
    below = nodes.where("not shared and parent_shared").drop("parent_conv_id").select("shard", "depth", "parent_k1", "parent_k2", "conv_id", *sums, "ends")
    below = below.unionByName(merged.select(*below.columns)).join(above, ["shard", "depth", "parent_k1", "parent_k2"], "left")
    every = nodes.where("not shared and not parent_shared").select(*out).unionByName(below.select(*out))
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                        (F.col("gross") - F.col("owned")).alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))
