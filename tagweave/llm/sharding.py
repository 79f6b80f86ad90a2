"""Shards of equal row counts with few cut links, by balanced label propagation.

Documents that belong together share a hub (equal texts share one; an ordinary
link is a hub of two). Every linked row begins with a hashed label. In each
round a hub counts its members by shard and offers its strongest shard, and
members for whom it holds more fellows than their present shard want to move
there. How many may is decided for each pair of shards, so that what comes in
fits into the free slots and those given up in the same round. Rounds go on
while they cut less. Hubs that quotas still keep apart, and some from shards
that the hashes filled beyond their quota, are then placed whole, largest first,
into the fullest shard that has room for them; that needs only counts of sizes.
Where rows have several hubs, all that hubs connect is placed so at first, if a
shard can take it, and the rounds start from there.

Loads and quotas are one number a shard or a pair of shards, hub sizes one a
size, so the driver holds nothing that grows with the documents. A last pass
makes sizes exact: what exceeds a shard's quota, and all documents without
links, fill the free slots. Ranks come from counts of bounded cells and a row
number within each, never from one sorted partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import components, cut, drop

#: Rows that one ranking cell should hold.
CELL_ROWS = 2000


def _fill(sizes: dict[int, int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(size, first rank, end rank, shard): where the hubs of each size go by rank, largest first, into the fullest shard with room.

    Hubs that fit nowhere go where most room is; what then exceeds a shard is moved by the last pass.
    """
    room, out, over = list(room), [], []
    for size in sorted(sizes, reverse=True):
        left, rank = sizes[size], 0
        for s in sorted(range(len(room)), key=lambda s: (room[s], s)):
            take = min(left, max(room[s], 0) // size)
            if take:
                out.append((size, rank, rank + take, s))
                room[s] -= take * size
                rank, left = rank + take, left - take
        if left:
            over.append((size, rank, rank + left))
    for size, rank, end in over:
        for r in range(rank, end):  # no more than there are shards, or hubs larger than a shard
            s = max(range(len(room)), key=lambda s: room[s])
            out.append((size, r, r + 1, s))
            room[s] -= size
    return out


def _whole_hubs(own: DataFrame, room: list[int], cell_rows: int) -> DataFrame:
    """(hub, shard) of ``own``, (row_id, hub) with a unique ``row_id``: whole hubs by counts."""
    spark = own.sparkSession
    hubs = cut(own.groupBy("hub").agg(F.count(F.lit(1)).alias("n")), "hubs")
    sizes = {x["n"]: x["hubs"] for x in hubs.groupBy("n").agg(F.count(F.lit(1)).alias("hubs")).collect()}
    # hubs of one size are ranked in bounded cells
    many = max(1, -(-sum(sizes.values()) // cell_rows))
    hubs = hubs.withColumn("cell", F.pmod(F.xxhash64("hub"), F.lit(many)))
    cells = hubs.groupBy("n", "cell").agg(F.count(F.lit(1)).alias("count"))
    before = Window.partitionBy("n").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("n", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("n", "cell").orderBy("hub")) - 1
    ranked = hubs.withColumn("rn", rank).join(cells, ["n", "cell"]).select("hub", "n", (F.col("before") + F.col("rn")).alias("rank"))
    plan = spark.createDataFrame(_fill(sizes, room), "n long, since long, until long, shard int")
    return ranked.join(F.broadcast(plan), "n").where("rank >= since and rank < until").select("hub", "shard")


def _joined(own: DataFrame, linked: DataFrame, quota: int) -> DataFrame:
    """``own`` with one hub for all rows that hubs connect, where a shard can take them; else each row's own."""
    low = linked.groupBy("hub").agg(F.min("row_id").alias("b"))
    roots = components(linked.join(low, "hub").select(F.col("row_id").alias("a"), "b"))
    rooted = own.join(roots.withColumnRenamed("node", "row_id"), "row_id", "left").withColumn("root", F.coalesce("root", "row_id"))
    small = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= quota).select("root", F.xxhash64("root", F.lit("joined")).alias("all"))
    return rooted.join(small, "root", "left").select("row_id", F.coalesce("all", "hub").alias("hub"))


def _admit(asked: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], float]:
    """Shares of the moves asked for, by (from, to), after which no shard exceeds its room; slots given up count as room."""
    share = dict.fromkeys(asked, 1.0)
    for _ in range(1000):
        come, go = [0.0] * len(room), [0.0] * len(room)
        for (a, b), n in asked.items():
            come[b] += n * share[a, b]
            go[a] += n * share[a, b]
        over = {b for b in range(len(room)) if come[b] > max(room[b], 0) + go[b] + 0.5}
        if not over:
            break
        for a, b in share:
            if b in over:
                share[a, b] *= (max(room[b], 0) + go[b]) / come[b]
    return share


def _cut_links(state: DataFrame) -> int:
    """Shards beyond the first of each hub, summed."""
    return state.groupBy("hub").agg((F.count_distinct("shard") - 1).alias("c")).agg(F.sum("c")).first()[0] or 0


def _propagate(state: DataFrame, shards: int, quota: int) -> DataFrame:
    """(row_id, hub, shard): members after label propagation under the quota, until three rounds in a row cut no less."""
    best, least, r, idle = state, _cut_links(state), 0, 0
    while least and idle < 3:
        load = dict.fromkeys(range(shards), 0) | {
            x["shard"]: x["n"]
            for x in state.select("row_id", "shard").distinct().groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()
        }
        votes = state.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
        # ties between shards fall differently for each hub, so that they don't all choose one
        votes = votes.select("hub", "shard", F.struct("n", F.xxhash64("hub", "shard").alias("tie")).alias("power"))
        offer = votes.groupBy("hub").agg(F.max("power").alias("offered"), F.max_by("shard", "power").alias("to"))
        # hub and shard decide, so the wishes are one row for each pair, joined to the members afterwards
        wish = votes.join(offer, "hub").where("offered > power and `to` <> shard").select("hub", "shard", "to", "offered")
        want = (
            state.join(wish, ["hub", "shard"])
            .groupBy("row_id", "shard")
            .agg(F.max_by("to", "offered").alias("to"))
        )
        want = cut(want, "moves")
        asked = {(x["shard"], x["to"]): x["n"] for x in want.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not asked:
            drop(want)
            break
        admitted = _admit(asked, [quota - load[s] for s in range(shards)])
        share = F.create_map(*[F.lit(v) for (a, b), x in admitted.items() for v in (a * shards + b, x)])
        moved = want.where(
            F.pmod(F.xxhash64("row_id", F.lit(r)), F.lit(1 << 20)) < share[F.col("shard") * shards + F.col("to")] * (1 << 20)
        )
        new = state.join(moved.select("row_id", "to"), "row_id", "left").select(
            "row_id", "hub", F.coalesce("to", "shard").alias("shard")
        )
        new = cut(new, "labels")
        drop(want)
        if state is not best:
            drop(state)
        state, r = new, r + 1
        now = _cut_links(state)
        idle = 0 if now < least else idle + 1
        if now < least:
            drop(best)
            best, least = state, now
    return best


def _settled(state: DataFrame, target: list[int], cell_rows: int) -> DataFrame:
    """(row_id, hub, shard): hubs that propagation brought together stay where they are; the others are placed whole into what these leave.

    Of a shard with more rows than its target, about as many hubs as are too
    many go with the others, chosen by hash.
    """
    hubs = state.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.min("shard").alias("shard"), F.max("shard").alias("top"))
    hubs = cut(hubs.select("hub", "n", F.when(F.col("shard") == F.col("top"), F.col("shard")).alias("at")), "together")
    load = {x["at"]: (x["n"], x["most"]) for x in hubs.where("at is not null").groupBy("at").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()}
    leave = {s: (n - target[s] + 4 * ((n - target[s]) * most) ** 0.5 + 2 * most) / n for s, (n, most) in load.items() if n > target[s]}
    chosen = F.lit(False)
    for s, share in leave.items():
        chosen = chosen | ((F.col("at") == s) & (F.pmod(F.xxhash64("hub", F.lit("leave")), F.lit(1 << 20)) < share * (1 << 20)))
    stay = hubs.where(F.col("at").isNotNull() & ~chosen).select("hub", F.col("at").alias("shard"))
    taken = {x["shard"]: x["n"] for x in hubs.join(stay, "hub").groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    rest = state.select("row_id", "hub").join(hubs.where(F.col("at").isNull() | chosen).select("hub"), "hub")
    placed = _whole_hubs(rest, [t - taken.get(s, 0) for s, t in enumerate(target)], cell_rows)
    return state.select("row_id", "hub").join(stay.union(placed), "hub").select("row_id", "hub", "shard")


def balanced_shards(
    nodes: DataFrame, members: DataFrame, shards: int = 40, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """(row_id, shard, slot): counts at most one apart, slots gapless from 0 in each shard.

    ``nodes`` has a unique ``row_id``; ``members`` has (row_id, hub), both not
    null. Hubs of one member link nothing. A hub with more members than a shard
    can take is split into as many parts as it needs.
    """
    total = nodes.count()
    if not total:
        return nodes.select("row_id", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    quota = -(-total // shards)
    target = [total // shards + (s < total % shards) for s in range(shards)]
    sizes = members.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / quota)
    linked = members.join(sizes, "hub").select(
        "row_id", F.xxhash64("hub", F.pmod(F.xxhash64("row_id", F.lit(-1)), parts)).alias("hub")
    )
    linked = cut(linked, "linked")
    own = cut(linked.groupBy("row_id").agg(F.min("hub").alias("hub"), F.count_distinct("hub").alias("hubs")), "own")
    if own.where("hubs > 1").take(1):
        own = cut(_joined(own, linked, quota), "own")
        placed = own.join(_whole_hubs(own, target, cell_rows), "hub").select("row_id", "shard")
        state = _propagate(cut(linked.join(placed, "row_id"), "labels"), shards, quota).groupBy("row_id").agg(F.min("shard").alias("part"))
        placed = own.select("row_id", "hub").join(state, "row_id")
    else:
        start = cut(linked.withColumn("shard", F.pmod(F.xxhash64("row_id", F.lit("label")), F.lit(shards)).cast("int")), "labels")
        state = _propagate(start, shards, quota)
        placed = _settled(state, target, cell_rows).withColumnRenamed("shard", "part")
    every = nodes.select("row_id").join(placed, "row_id", "left")
    side = max(1, round((quota / cell_rows) ** 0.5 + 0.499))
    many = max(1, -(-total // cell_rows))
    cell = F.when(
        F.col("hub").isNotNull(),
        F.pmod(F.xxhash64("hub"), F.lit(side)) * side + F.pmod(F.xxhash64("row_id"), F.lit(side)),
    ).otherwise(F.pmod(F.xxhash64("row_id"), F.lit(many)))
    every = cut(every.select("row_id", "hub", F.coalesce("part", F.lit(-1)).alias("part"), cell.alias("cell")), "cells")
    cells = every.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("part").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("part", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("part", "cell").orderBy("hub", "row_id")
    ranked = every.withColumn("rn", F.row_number().over(own)).join(cells, ["part", "cell"])
    ranked = ranked.select("row_id", "part", (F.col("before") + F.col("rn") - 1).alias("rank"))
    # one number a shard: what is there, what is too much, where the pool of loose documents goes
    load = {x["part"]: x["n"] for x in every.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    pool_at, free_at = load.get(-1, 0), 0
    pool_from, case_shard, case_slot = {-1: 0}, None, None
    for s in range(shards):
        have = load.get(s, 0)
        if have > target[s]:
            pool_from[s] = pool_at - target[s]
            pool_at += have - target[s]
        elif have < target[s]:
            upto = free_at + target[s] - have
            hit = F.col("pool") < upto
            case_shard = F.when(hit, F.lit(s)) if case_shard is None else case_shard.when(hit, F.lit(s))
            slot = F.col("pool") + (have - free_at)
            case_slot = F.when(hit, slot) if case_slot is None else case_slot.when(hit, slot)
            free_at = upto
    keep = F.lit(False)
    pool = F.lit(None).cast("long")
    for s, add in pool_from.items():
        pool = F.when(F.col("part") == s, F.col("rank") + F.lit(add)).otherwise(pool)
    for s in range(shards):
        if load.get(s):
            keep = keep | ((F.col("part") == s) & (F.col("rank") < target[s]))
    ranked = ranked.withColumn("keep", keep).withColumn("pool", pool)
    none = F.lit(None).cast("int")
    return ranked.select(
        "row_id",
        F.when(F.col("keep"), F.col("part")).otherwise(case_shard if case_shard is not None else none).cast("int").alias("shard"),
        F.when(F.col("keep"), F.col("rank")).otherwise(case_slot if case_slot is not None else none).cast("long").alias("slot"),
    )


def shard_documents(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): documents with equal texts are linked; the law is ``rows``.

    Size is the text's UTF-8 bytes plus 16; a null text has none and is linked
    with nothing, nor are empty ones. Each row counts, repeated ones too, and
    rows without an id as well. Ties are broken by digests of texts and rows;
    other columns are left aside; an empty table gives an empty one.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(F.octet_length(text) > 0, F.xxhash64(text, F.crc32(text.cast("binary")))).alias("hub"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    rows = cut(rows, "sizes")
    got = balanced_shards(rows, rows.where("hub is not null").select("row_id", "hub"), shards)
    return rows.join(got, "row_id").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
