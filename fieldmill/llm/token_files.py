"""Token ids in raw binary shards, with a minimal perfect hash index from document key to place.

Shard file: records in ascending doc_id order (nulls first, then by a hash of the text), one after the other:
    int64   doc_id (0 where null)
    uint32  number of ids, end id included; bit 31: doc_id is null
    uint16  the ids, little-endian; the last one is the end id 0
Spark's text writer writes the records as they are (its line separator is the end id), so files are committed by Spark on
any file system. Shards follow one another in the order of their part numbers.

Shards follow the size of the text (SHARD_TEXT bytes each, at least one per shuffle partition), so a file stays small enough to be one cell
whatever the size of the table.

Index: one row per group of keys. A key is (doc_id, its number among rows of the same doc_id). Inside a group every key
has a slot of its own (hash, displace and compare); the slot holds a fingerprint, shard, byte offset and count, so a
lookup is constant time and a foreign key is told by its fingerprint. Rows without doc_id are in the shards, not in the index.

Reading by key goes through the index alone: it names shard, offset and count, and the ids are cut from the shard there. A key of the
table that the index does not hold, or that is found with another doc_id at its place, is an error.

Null text: no ids but the end id. Empty table: no records, an empty index. Repeated doc_ids: each row is kept and indexed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmill.llm.common import new_folder, slices, stored
from fieldmill.llm.encoder import SLICE, batch_encoder

END = "\x00\x00"
NO_ID = 1 << 31
HEAD = np.dtype([("doc_id", "<i8"), ("n", "<u4")])
#: Keys of one index group, about.
GROUP_KEYS = 20_000
KEYS_PER_BUCKET = 3
#: Bytes of text of which one shard is made.
SHARD_TEXT = 48 << 20
ENTRIES = "doc_id long, shard int, at long, before long, n_tokens int, copy long, in_first_run boolean"
INDEX = "grp long, n int, seed int, pilots binary, prints binary, shards binary, ats binary, counts binary"
FOUND = "doc_id long, copy long, start long, shard int, at long, n_tokens int"
READ = "name long, named boolean, copy long, start long, shard int, at long, n_tokens int, ids_crc32 long"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, shards: int) -> None:
    """docs (doc_id, text) as `shards` files below `folder`. Ranges of (doc_id, hash of text): no hot doc_id in one task."""
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = batch_encoder(tokenizer, drops_space=False, width=2)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, ends = encoder.encode(part.column("text"))
                heads = np.zeros(part.num_rows, HEAD)
                none = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                heads["doc_id"] = part.column("doc_id").fill_null(0).to_numpy()
                heads["n"] = np.diff(ends) + 1 + np.where(none, NO_ID, 0)
                head, body, step = heads.tobytes(), ids.tobytes(), HEAD.itemsize
                out = [head[step * i:step * (i + 1)] + body[2 * first:2 * stop]
                       for i, (first, stop) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
    rows = rows.repartitionByRange(shards, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    (rows.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("record"))
     .write.option("lineSep", END).text(folder))


def shard_files(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, content): one row per shard file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int").alias("shard"), "content")


def walk(content: bytes) -> Iterator[tuple[int | None, int, int, memoryview]]:
    """(doc_id, byte offset of the ids, their number, the ids as bytes) of each record."""
    view, at, step = memoryview(content), 0, HEAD.itemsize
    while at < len(content):
        doc_id, n = np.frombuffer(content, HEAD, 1, at)[0].tolist()
        doc_id, n = (None, n - NO_ID) if n >= NO_ID else (doc_id, n)
        yield doc_id, at + step, n, view[at + step:at + step + 2 * n]
        at += step + 2 * n


def read_entries(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the files: doc_id, shard, at (byte offset), before (ids before it in the shard), n_tokens, copy (its number
    among the rows of its doc_id in this shard, which stand together), in_first_run (its doc_id is the shard's first)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                rows, before, now, copy, first = [], 0, NO_ID, 0, True
                for doc_id, at, n, _ in walk(content.as_py()):
                    copy = copy + 1 if rows and doc_id == now else 0
                    first = first and (not rows or doc_id == now)
                    now = doc_id
                    rows.append((doc_id, shard, at, before, n, copy, first))
                    before += n
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
                names = ["doc_id", "shard", "at", "before", "n_tokens", "copy", "in_first_run"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return shard_files(spark, folder).mapInArrow(read, ENTRIES)


def numbered(entries: DataFrame) -> DataFrame:
    """doc_id, copy (0 for the first row of a doc_id, then 1, 2, ...), shard, at, n_tokens, start (ids of all records before).

    The files are in the order of doc_id, so all but a shard's first run are numbered in the shard already. How many rows of the first
    run's doc_id, and how many ids, earlier shards hold is worked out from one or two rows per shard.
    """
    size = F.col("copy") + 1
    sums = entries.groupBy("shard").agg(
        F.sum("n_tokens").alias("_sum"), F.max(F.when(F.col("in_first_run"), size)).alias("_head"),
        F.min_by("doc_id", "at").alias("_first_id"), F.max_by(F.struct("doc_id", "copy", "in_first_run"), "at").alias("_last"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over one row per shard
    base = sums.select("*", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    # along each doc_id: the last run of every shard, and between them the shards that go on with it
    ends = base.select(F.col("_last.doc_id").alias("_id"), "shard", F.lit(1).alias("_kind"), (F.col("_last.copy") + 1).alias("_rows"))
    goes_on = base.select(F.col("_first_id").alias("_id"), "shard", F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_rows"))
    along = Window.partitionBy("_id").orderBy("shard", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    held = ends.union(goes_on).where("_id is not null").withColumn("_held", F.sum("_rows").over(along)).where("_kind = 0").select("shard", "_held")
    shards = base.select("shard", "_start").join(held, "shard", "left")
    rows = entries.join(F.broadcast(shards), "shard")  # one row per shard of SHARD_TEXT bytes
    copy = F.col("copy") + F.when(F.col("in_first_run"), F.coalesce("_held", F.lit(0))).otherwise(0)
    return rows.select("doc_id", copy.alias("copy"), "shard", "at", "n_tokens", (F.col("_start") + F.col("before")).alias("start"))


# ---- minimal perfect hash

def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mixing of integers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
        return x ^ (x >> np.uint64(32))


def key_hash(doc_id: np.ndarray, copy: np.ndarray) -> np.ndarray:
    return mixed(mixed(doc_id.astype(np.int64).view(np.uint64), 1) ^ copy.astype(np.uint64), 2)


def slots(keys: np.ndarray, n: int, seed: int, pilots: np.ndarray) -> np.ndarray:
    """The slot of each key hash: its bucket's pilot displaces its second hash."""
    pilot = pilots[(mixed(keys, 3 + seed) % np.uint64(len(pilots))).astype(np.int64)]
    return place(keys, n, seed, pilot)


def place(keys: np.ndarray, n: int, seed: int, pilot: np.ndarray) -> np.ndarray:
    """A pilot is a multiplier in its upper and a shift in its lower half."""
    with np.errstate(over="ignore"):
        a, b = pilot >> np.uint64(32), pilot & np.uint64(0xFFFFFFFF)
        h1 = mixed(keys, 103 + seed) & np.uint64(0xFFFFFFFF)
        h2 = mixed(keys, 203 + seed) >> np.uint64(40)
        return ((h1 + a * h2 + b) % np.uint64(n)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[int, np.ndarray]:
    """(seed, pilots) that give every key hash of the group a slot of its own among len(keys) slots."""
    n = len(keys)
    n_buckets = n // KEYS_PER_BUCKET + 1
    for seed in range(64):
        bucket = (mixed(keys, 3 + seed) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=n_buckets)
        ends = np.cumsum(sizes)
        taken, pilots, good = np.zeros(n, bool), np.zeros(n_buckets, np.uint64), True
        by_size = np.argsort(-sizes, kind="stable")
        singles = by_size[sizes[by_size] == 1]
        for b in by_size[sizes[by_size] > 1].tolist():
            own = keys[order[ends[b] - sizes[b]:ends[b]]]
            for a in range(4096):
                tries = (np.uint64(a) << np.uint64(32)) + np.arange(0, min(n, 64 << min(a, 6)), dtype=np.uint64)
                at = place(own[:, None], n, seed, tries[None, :])
                free = ~taken[at].any(0)
                line = np.sort(at, axis=0)
                free &= (line[1:] != line[:-1]).all(0)
                if free.any():
                    k = int(free.argmax())
                    pilots[b] = tries[k]
                    taken[at[:, k]] = True
                    break
            else:
                good = False
                break
        if good:
            left = np.flatnonzero(~taken)
            own = keys[order[ends[singles] - 1]]
            at = place(own, n, seed, np.zeros(len(own), np.uint64))
            pilots[singles] = ((left - at) % n).astype(np.uint64)
            return seed, pilots
    raise ValueError("two keys of a group have the same hash")


def build_index(rows: DataFrame, groups: int) -> DataFrame:
    """The index of (doc_id, copy, shard, at, n_tokens); rows without doc_id have no key. A group has about GROUP_KEYS rows."""
    def index(frame: pd.DataFrame) -> pd.DataFrame:
        keys = key_hash(frame["doc_id"].to_numpy(), frame["copy"].to_numpy())
        seed, pilots = build(keys)
        at = slots(keys, len(keys), seed, pilots)
        turn = np.empty(len(keys), np.int64)
        turn[at] = np.arange(len(keys))
        prints = (mixed(keys, 7) & np.uint64(0xFFFFFFFF)).astype("<u4")
        of = lambda name, kind: frame[name].to_numpy().astype(kind)[turn].tobytes()
        return pd.DataFrame({"grp": frame["grp"].iloc[:1].to_numpy(), "n": [len(keys)], "seed": [seed], "pilots": [pilots.tobytes()],
                             "prints": [prints[turn].tobytes()], "shards": [of("shard", "<i4")], "ats": [of("at", "<i8")],
                             "counts": [of("n_tokens", "<i4")]})

    keyed = rows.where("doc_id is not null").select(group_of(groups), "doc_id", "copy", "shard", "at", "n_tokens")
    return keyed.groupBy("grp").applyInPandas(index, INDEX)


def group_of(groups: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(groups)).cast("long").alias("grp")


def look_up(keys: DataFrame, index: DataFrame, groups: int, all_known: bool = False) -> DataFrame:
    """The place of each key (doc_id, copy, and start, which is handed on) of the index; keys that it doesn't hold, by their fingerprint,
    give no row, or, where all are known to be there, an error."""
    def find(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "copy", "start", "shard", "at", "n_tokens"]
        at = known = np.zeros(len(asked), bool)
        if len(rows) and len(asked):
            row = rows.iloc[0]
            hashes = key_hash(asked["doc_id"].to_numpy(), asked["copy"].to_numpy())
            at = slots(hashes, int(row["n"]), int(row["seed"]), np.frombuffer(row["pilots"], np.uint64))
            known = np.frombuffer(row["prints"], "<u4")[at] == (mixed(hashes, 7) & np.uint64(0xFFFFFFFF)).astype("<u4")
        if all_known and not known.all():
            lost = asked[~known].iloc[0]
            raise ValueError(f"the index does not hold doc_id {lost['doc_id']}, copy {lost['copy']}")
        if not known.any():
            return pd.DataFrame({n: [] for n in names}).astype("int64")
        at = at[known]
        return asked.loc[known, ["doc_id", "copy", "start"]].assign(
            shard=np.frombuffer(row["shards"], "<i4")[at], at=np.frombuffer(row["ats"], "<i8")[at], n_tokens=np.frombuffer(row["counts"], "<i4")[at])

    start = F.col("start") if "start" in keys.columns else F.lit(0).cast("long").alias("start")
    asked = keys.where("doc_id is not null").select(group_of(groups), "doc_id", "copy", start)
    return asked.groupBy("grp").cogroup(index.groupBy("grp")).applyInPandas(find, FOUND)


def digests(places: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Places (doc_id, null where the record has none, and copy, start, shard, at, n_tokens) with ids_crc32, over the ids (as 32-bit
    integers) that stand there. A place that holds another record is an error."""
    def cut(asked: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        content = files["content"].iloc[0] if len(files) else b""
        sums = []
        for name, named, at, n in zip(*(asked[c].tolist() for c in ("name", "named", "at", "n_tokens")), strict=True):
            head = (name, n) if named else (0, n + NO_ID)
            if at + 2 * n > len(content) or np.frombuffer(content, HEAD, 1, at - HEAD.itemsize)[0].tolist() != head:
                raise ValueError(f"the place that the index names for doc_id {name if named else None} holds another record")
            sums.append(zlib.crc32(np.frombuffer(content, "<u2", n, at).astype("<u4")))
        return asked.assign(ids_crc32=np.array(sums, np.int64))

    asked = places.select(F.coalesce("doc_id", F.lit(0)).alias("name"), F.col("doc_id").isNotNull().alias("named"), "copy", "start", "shard", "at", "n_tokens")
    # a shard's places and its file meet in one task: as many rows, and as many bytes, as SHARD_TEXT of text makes
    read = asked.groupBy("shard").cogroup(shard_files(spark, folder).groupBy("shard")).applyInPandas(cut, READ)
    return read.select(F.when(F.col("named"), F.col("name")).alias("doc_id"), "copy", "start", "shard", "at", "n_tokens", "ids_crc32")


def fetch(found: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, copy, ids): the ids at the places that look_up() found, cut from the shard files."""
    def cut(asked: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        content = files["content"].iloc[0] if len(files) else b""
        ids = [np.frombuffer(content, "<u2", int(n), int(at)).tolist()
               for at, n in zip(asked["at"], asked["n_tokens"], strict=True)]
        return pd.DataFrame({"doc_id": asked["doc_id"], "copy": asked["copy"], "ids": pd.Series(ids, asked.index, object)})

    return (found.groupBy("shard").cogroup(shard_files(spark, folder).groupBy("shard"))
            .applyInPandas(cut, "doc_id long, copy long, ids array<int>"))


def write_indexed(docs: DataFrame, tokenizer: str, shards: int | None = None) -> tuple[str, DataFrame, DataFrame, int]:
    """Writes shards and index into the shared folder: (folder, numbered rows, index, number of groups)."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-ids")
    if not shards:
        size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        shards = max(size // SHARD_TEXT + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    write_shards(docs, f"{folder}/ids", tokenizer, shards)
    rows = stored(numbered(stored(read_entries(spark, f"{folder}/ids"), "token-entries")), "token-rows")
    groups = rows.count() // GROUP_KEYS + 1
    build_index(rows, groups).write.parquet(f"{folder}/index")
    return folder, rows, spark.read.schema(INDEX).parquet(f"{folder}/index"), groups


def token_places(docs: DataFrame, tokenizer: str, shards: int | None = None) -> DataFrame:
    """Writes docs, looks every key up in the index and reads the ids' digest at the place it names.

    doc_id, start, n_tokens, ids_crc32, shard, at. Rows without doc_id have no key; their places come from the walk over the files.
    """
    folder, rows, index, groups = write_indexed(docs, tokenizer, shards)
    found = look_up(rows, index, groups, all_known=True)
    nameless = rows.where("doc_id is null").select("doc_id", "copy", "start", "shard", "at", "n_tokens")
    read = digests(found.unionByName(nameless), docs.sparkSession, f"{folder}/ids")
    return read.select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32", "shard", "at")
