"""Balanced label propagation: documents with equal texts gather in one shard, shards stay even (law `rows`).

A group of equal texts larger than a shard gets as few shards as hold it. The other linked documents start spread by a hash.
In every round each group counts its members per shard and wants those outside its leading shard to follow; the moves into
a shard are admitted, by groups, as far as its free places and the rows that leave it in the same round make room. The
rounds end when no admitted move is left, or after `rounds`; the result does not lean on their number, because groups that
are still apart then, or over their shard's size, are laid as wholes along the free places. Only a group that crosses from
one shard to the next there, and fits whole into no gap, is cut: fewer groups than there are shards. Documents without
links fill the rest.

All that goes through the driver is per shard: counts, groups larger than a shard, groups that cross. Ranks are made from
sorted ranges and their counts, so no task sees a whole shard or group. Null text: size 1, crc32 of the empty text, no
links. Repeated rows are documents each. Null doc_id is allowed. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.llm.common import stored

SHARDS = 16
ROUNDS = 8


def ranked(rows: DataFrame, group: str, order: list[str], name: str, weight: str | None = None) -> DataFrame:
    """rows with `name`: 0, 1, ... within `group` in the order of `order`, which tells rows apart; the sum of `weight` before the row, if given."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order]
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, "ranked-dealt")
    each = F.col(weight) if weight else F.lit(1)
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(group, "_part").agg(F.sum(each).alias("_n"))
    counts = counts.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy("_part", group).orderBy(*order)
    upto = F.sum(each).over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow)) if weight else F.row_number().over(local)
    return dealt.join(counts, [group, "_part"]).withColumn(name, F.col("_before") + upto - each).drop("_part", "_before")


def share(*columns: str | Column) -> Column:
    """A number from 0 to 1 that depends on the columns alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1_000_003)) / 1_000_003


def numbers(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def starts(sizes: list[int]) -> list[int]:
    return [sum(sizes[:s]) for s in range(len(sizes))]


def place(sizes: list[int], at: Column) -> Column:
    """Which of the intervals of these sizes, one after the other, holds the number."""
    return F.size(F.filter(numbers(starts(sizes)), lambda x: x <= at)) - 1


def parted(groups: list[tuple[bytes, int]], room: list[int]) -> list[tuple[bytes, int, int, int]]:
    """(g, first, end, shard) of the members of each group: whole in the tightest room, else in as few as hold it; takes from `room`."""
    out = []
    for g, members in sorted(groups, key=lambda x: (-x[1], x[0])):
        at = 0
        while at < members:
            whole = [s for s, r in enumerate(room) if r >= members - at]
            shard = min(whole, key=lambda s: room[s]) if whole else max(range(len(room)), key=lambda s: room[s])
            n = min(room[shard], members - at)
            out.append((g, at, at + n, shard))
            room[shard] -= n
            at += n
    return out


def admissible(flow: dict[tuple[int, int], int], load: list[int], room: list[int]) -> list[float]:
    """By target the share of the wanted moves {(from, to): rows} that fits, counting the places of rows that leave."""
    shards = range(len(room))
    wanted = [sum(n for (_, t), n in flow.items() if t == s) for s in shards]
    shares = [1.0 if w else 0.0 for w in wanted]
    while True:
        leaves = [sum(n * shares[t] for (f, t), n in flow.items() if f == s) for s in shards]
        fits = [min(shares[s], max(0.0, room[s] - load[s] + leaves[s]) / wanted[s]) if wanted[s] else 0.0 for s in shards]
        if max(a - b for a, b in zip(shares, fits, strict=True)) < 1e-3:
            return fits
        shares = fits


def gathered(linked: DataFrame, room: list[int], rounds: int) -> DataFrame:
    """linked (row, g, members) with the shard that label propagation gives each row; `room` by shard."""
    shards = len(room)
    start = place(room, share("row") * sum(room))
    state = stored(linked.withColumn("shard", start.cast("int")), "shards-state")
    for turn in range(rounds):
        votes = state.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("_n"))
        first = F.struct(-F.col("_n"), F.pmod(F.xxhash64("g", "shard"), F.lit(1_000_003)), F.col("shard").alias("shard"))
        leaders = votes.groupBy("g").agg(F.min(first)["shard"].alias("_to"))
        wish = stored(state.join(leaders, "g"), "shards-wish")
        load, flow = [0] * shards, {}
        for f in wish.groupBy("shard", "_to").agg(F.count(F.lit(1)).alias("n")).collect():
            load[f["shard"]] += f["n"]
            if f["_to"] != f["shard"]:
                flow[f["shard"], f["_to"]] = f["n"]
        shares = admissible(flow, load, room)
        if sum(n * shares[t] for (_, t), n in flow.items()) < 1:
            break
        moves = share("g", F.lit(turn)) < F.element_at(F.array(*map(F.lit, shares)), F.col("_to") + 1)
        state = stored(wish.withColumn("shard", F.when(moves, F.col("_to")).otherwise(F.col("shard"))).drop("_to"), "shards-state")
    return state


def settled(state: DataFrame, room: list[int]) -> tuple[DataFrame, list[tuple[bytes, int, int, int]]]:
    """(g, shard) of the groups that lie whole in a shard, and the parts of the few that don't; takes from `room`."""
    shards = len(room)
    groups = state.groupBy("g").agg(F.first("members").alias("members"), F.min("shard").alias("_box"), F.max("shard").alias("_high"))
    groups = groups.select("g", "members", (-F.col("members")).alias("_turn"), F.when(F.col("_box") == F.col("_high"), F.col("_box")).otherwise(
        F.lit(shards)).alias("_box"))
    upto = F.col("_start") + F.col("members")
    groups = ranked(groups, "_box", ["_turn", "g"], "_start", "members")
    stays = upto <= F.element_at(numbers([*room, 0]), F.col("_box") + 1)
    groups = stored(groups.select("g", "members", "_turn", F.when(stays, F.col("_box")).alias("shard")), "shards-groups")
    for r in groups.where("shard is not null").groupBy("shard").agg(F.sum("members").alias("n")).collect():
        room[r["shard"]] -= r["n"]
    rest = ranked(groups.where("shard is null").withColumn("_all", F.lit(0)), "_all", ["_turn", "g"], "_start", "members")
    rest = rest.withColumn("shard", place(room, F.col("_start")).cast("int"))
    ends = [a + r for a, r in zip(starts(room), room, strict=True)]
    rest = stored(rest.select("g", "members", F.when(upto <= F.element_at(numbers(ends), F.col("shard") + 1), F.col("shard")).alias("shard")),
                  "shards-rest")
    for r in rest.where("shard is not null").groupBy("shard").agg(F.sum("members").alias("n")).collect():
        room[r["shard"]] -= r["n"]
    cross = [(bytes(r["g"]), r["members"]) for r in rest.where("shard is null").collect()]  # one per border at most
    whole = groups.select("g", "shard").unionByName(rest.select("g", "shard")).where("shard is not null")
    return whole, parted(cross, room)


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("g"),
        F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "shards-rows")
    total = rows.count()
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    room = list(sizes)
    groups = rows.where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    groups = stored(groups, "shards-linked")
    # groups larger than a shard: no more than there are shards
    fits = F.col("members") <= max(1, total // shards)
    parts = parted([(bytes(r["g"]), r["members"]) for r in groups.where(~fits).collect()], room)
    few = lambda found: F.broadcast(rows.sparkSession.createDataFrame(found, "g binary, first long, end long, shard int"))
    linked = rows.select("row", "g").join(few(parts), "g", "left_anti").join(groups.where(fits), "g").select("row", "g", "members")
    state = gathered(linked, room, rounds)
    whole, cut = settled(state, room)
    parts += cut
    placed = state.select("row", "g").join(few(cut), "g", "left_anti").join(whole, "g").select("row", "shard")
    if parts:
        split = ranked(rows.select("row", "g").join(few(parts), "g", "left_semi"), "g", ["row"], "_at")
        placed = placed.unionByName(split.join(few(parts), "g").where("_at >= first and _at < end").select("row", "shard"))
    boxed = rows.join(placed, "row", "left").withColumn("_box", F.coalesce("shard", F.lit(shards))).drop("shard")
    boxed = stored(ranked(boxed, "_box", ["g", "row"], "_rank"), "shards-ranked")
    counts = {r["_box"]: r["n"] for r in boxed.groupBy("_box").agg(F.count(F.lit(1)).alias("n")).collect()}

    own = [min(sizes[s], counts.get(s, 0)) for s in range(shards)]
    over = [counts.get(s, 0) - own[s] for s in range(shards)] + [0]
    lone = counts.get(shards, 0)
    # place in the line of those that fill up: rows without links, then what each shard could not take
    first = [lone + sum(over[:s]) - own[s] for s in range(shards)] + [0]
    free = [size - n for size, n in zip(sizes, own, strict=True)]
    box, rank = F.col("_box"), F.col("_rank")
    stays = (box < shards) & (rank < F.element_at(numbers([*own, 0]), box + 1))
    line = rank + F.element_at(numbers(first), box + 1)
    filled = place(free, F.col("_line"))
    out = boxed.withColumns({"_stays": stays, "_line": line}).withColumn(
        "shard", F.when(F.col("_stays"), box).otherwise(filled).cast("int"))
    at = F.col("shard") + 1
    slot = F.when(F.col("_stays"), rank).otherwise(
        F.col("_line") - F.element_at(numbers(starts(free)), at) + F.element_at(numbers(own), at))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))
