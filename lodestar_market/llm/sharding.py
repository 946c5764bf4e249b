"""Sharding by balanced label propagation, in DataFrame functions alone.

Documents with equal texts are linked through their group (no pairs are made).
In each round every split group asks to bring its members together in the shard
that most of them are in (after the first round: of the shards with free
capacity).  Joins bring groups and documents together.  Each shard
has a quota of rows it may take in a round: its free capacity and what leaves
it in the same round.  Groups are granted whole, those that move most rows
first, as long as they fit the quota.  What doesn't fit asks again in the next
round, and stays split if it never fits.  At the end the documents, in the
order of their shards and groups, are cut into shards of exactly even counts,
which moves only documents at the seams.  A group larger than a shard's even
share can't be in one shard; its rows stand together before all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ._shared import cut, table

SHARDS = 8
ROUNDS = 6
#: Rows of a cell, the unit in which documents are numbered, and those of a part of a large group.
CELL_ROWS = 10_000
PART_ROWS = 1_000
#: Capacity of a shard during the rounds, over its even share.
LOAD = 1.05
#: Groups that move alike many rows are granted in so many lots.
LOTS = 256


def nodes_of(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, group and the first shard of each row."""
    text = F.col("text")
    raw = F.encode(text, "UTF-8")
    crc = F.coalesce(F.crc32(raw), F.lit(0).cast("long"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        crc.alias("text_crc32"),
        # 64 bits stand for the text (null is one of its own); should two texts share them, they only stand side by side.
        F.xxhash64(text).alias("group"),
        F.pmod(F.xxhash64("doc_id", F.lit("start")), F.lit(shards)).cast("int").alias("shard"),
    )


def requests(nodes: DataFrame, free: list[bool]) -> DataFrame:
    """group, target and moves: the free shard that most of a group is in, and how many members are elsewhere."""
    counts = nodes.groupBy("group", "shard").agg(F.count("*").alias("n"))
    of = counts.groupBy("group").agg(F.collect_list(F.struct("shard", "n")).alias("held"), F.sum("n").alias("members")).where(F.size("held") > 1)
    held = F.map_from_entries("held")  # at most one entry a shard
    choice = [F.struct(F.coalesce(F.try_element_at(held, F.lit(s)), F.lit(0)).alias("n"), F.xxhash64("group", F.lit(s)).alias("draw"), F.lit(s).alias("shard")) for s, ok in enumerate(free) if ok]
    best = F.array_max(F.array(*choice))
    return of.select("group", best["shard"].alias("target"), (F.col("members") - best["n"]).alias("moves"))


def quotas(held: list[int], asked: dict[tuple[int, int], int], capacity: int) -> list[int]:
    """Rows that each shard may take: what is free and what leaves it, if all grant their share."""
    shards = range(len(held))
    coming = [sum(asked.get((a, b), 0) for a in shards) for b in shards]
    share = [1.0] * len(held)
    for _ in range(50):
        leaving = [sum(asked.get((a, b), 0) * share[b] for b in shards) for a in shards]
        share = [min(1.0, max(0.0, capacity - held[b] + leaving[b]) / coming[b]) if coming[b] else 0.0 for b in shards]
    return [int(share[b] * coming[b] + 1e-6) for b in shards]


def granted(asking: DataFrame, quota: list[int]) -> DataFrame:
    """group and target of the requests that fit: whole groups, those that move most first.

    Sums are taken over lots of groups that move about as many rows, of which
    there are at most 64 * LOTS a shard, so that no shard's groups go to one task.
    """
    limit = F.get(F.array(*[F.lit(q) for q in quota]), F.col("target"))
    lot = [F.floor(F.log2("moves")).cast("int").alias("scale"), F.pmod(F.xxhash64("group", F.lit("lot")), F.lit(LOTS)).cast("int").alias("lot")]
    fitting = asking.where(F.col("moves") <= limit).select("group", "target", "moves", *lot)
    lots = fitting.groupBy("target", "scale", "lot").agg(F.sum("moves").alias("moves"))
    up_to = F.sum("moves").over(W.Window.partitionBy("target").orderBy(F.desc("scale"), "lot"))
    passed = lots.withColumn("up_to", up_to).where(F.col("up_to") <= limit).select("target", "scale", "lot")
    return fitting.join(F.broadcast(passed), ["target", "scale", "lot"]).select("group", "target")


def propagate(nodes: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """Up to ``rounds`` rounds under quotas, or until no group is split.

    Groups of more rows than a shard's even share get the label -1 and ask for
    nothing.  At most shards * shards counts reach the driver in a round.
    """
    total = nodes.count()
    sizes = nodes.groupBy("group").agg(F.count("*").alias("members"))
    large = sizes.where(F.col("members") > total // shards).select("group", F.lit(-1).alias("target"))  # fewer than shards
    nodes = cut(nodes.join(F.broadcast(large), "group", "left").withColumn("shard", F.coalesce("target", "shard")).drop("target"))
    # Free space for one whole group, besides the load: the final cut evens it out.
    room = sizes.where(F.col("members") <= total // shards).agg(F.coalesce(F.max("members"), F.lit(0))).first()[0]
    for round_ in range(rounds):
        counts = dict(nodes.where("shard >= 0").groupBy("shard").agg(F.count("*")).collect())
        held = [counts.get(s, 0) for s in range(shards)]
        capacity = int(sum(held) * LOAD / shards) + room
        asking = cut(requests(nodes.where("shard >= 0"), [not round_ or h < capacity for h in held]))
        wishes = nodes.join(asking, "group").where("shard <> target").groupBy("shard", "target").agg(F.count("*").alias("n")).collect()
        quota = quotas(held, {(r["shard"], r["target"]): r["n"] for r in wishes}, capacity)
        if not any(quota):
            break
        moved = nodes.join(granted(asking, quota), "group", "left").withColumn("shard", F.coalesce("target", "shard")).drop("target")
        nodes = cut(moved)
    return nodes


def cut_links(assigned: DataFrame, group: str = "group", shard: str = "shard") -> int:
    """Rows that aren't in the shard where most of their group is: the fewest links that are cut."""
    counts = assigned.groupBy(group, shard).agg(F.count("*").alias("n")).groupBy(group).agg((F.sum("n") - F.max("n")).alias("cut"))
    return counts.agg(F.coalesce(F.sum("cut"), F.lit(0))).first()[0]


def settle(nodes: DataFrame, shards: int) -> DataFrame:
    """Cut the nodes, ordered by shard and group, into even counts; add slot.

    Numbers are given cell by cell: a cell holds the nodes of one shard whose
    groups fall in one bucket, or a part of a large group.  The cells' counts
    give each its first number, those of a shard after those of the shards before.
    """
    total = nodes.count()
    buckets = max(64, total // CELL_ROWS)
    sizes = nodes.groupBy("group").agg(F.count("*").alias("members")).where(F.col("members") > PART_ROWS).withColumn("large", F.col("group"))
    bucket = F.pmod(F.xxhash64("group", F.lit("cell")), F.lit(buckets)).cast("int")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.ceil(F.col("members") / PART_ROWS)).cast("int")
    placed = nodes.join(sizes, "group", "left").withColumns({"bucket": bucket, "large": F.coalesce("large", F.lit(0)), "part": F.coalesce(part, F.lit(-1))})
    cell = ["shard", "bucket", "large", "part"]
    counts = placed.groupBy(*cell).agg(F.count("*").alias("n"))
    within_shard = F.sum("n").over(W.Window.partitionBy("shard").orderBy(*cell[1:]).rowsBetween(W.Window.unboundedPreceding, -1))
    of_shard = counts.groupBy("shard").agg(F.sum("n").alias("n"))  # shards + 1 rows
    before_shard = F.sum("n").over(W.Window.orderBy("shard").rowsBetween(W.Window.unboundedPreceding, -1))
    offsets = of_shard.select("shard", F.coalesce(before_shard, F.lit(0)).alias("offset"))
    firsts = counts.withColumn("first", F.coalesce(within_shard, F.lit(0))).join(F.broadcast(offsets), "shard").select(*cell, (F.col("first") + F.col("offset")).alias("first"))
    within = W.Window.partitionBy(*cell).orderBy("group", "doc_id", "size", "text_crc32")
    number = F.row_number().over(within) - 1 + F.col("first")
    each, more = divmod(total, shards)
    numbered = placed.join(firsts, cell).withColumn("number", number)
    if not each:
        return numbered.withColumn("shard", F.col("number").cast("int")).withColumn("slot", F.lit(0).cast("long"))
    border = more * (each + 1)
    past = F.col("number") - border
    shard = F.when(past < 0, F.expr(f"number div {each + 1}")).otherwise(more + F.expr(f"(number - {border}L) div {each}"))
    slot = F.when(past < 0, F.expr(f"number % {each + 1}")).otherwise(F.expr(f"(number - {border}L) % {each}"))
    return numbered.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long"))


def assign_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row, by law ``rows``.

    Counts of shards differ by at most one; slots run from 0 in each shard
    without gaps.  Equal texts (null is a text of its own) keep together but
    for the seams of a cut.  A null text has size 1 and the CRC of nothing.
    Repeated rows are placed each for itself; a null doc_id is a value like
    others.  An empty table gives an empty table.  Extra columns are left out.
    """
    nodes = cut(nodes_of(docs, shards))  # the texts are read once
    settled = settle(propagate(nodes, shards, rounds), shards)
    return settled.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 6 over the whole of ``documents``."""
    return assign_shards(table(spark, sf_dir, "documents"))
