"""Sharding by balanced label propagation, with DataFrame functions only.

Rows have a size and may belong to hubs (here: rows of equal text).  A row's label is its shard.  It
starts as a hash; in every round a hub's homes are the shards that hold most of its rows, as many of
them as its bytes need at least, and rows elsewhere ask to move to one of them.  A row of several hubs sums their
votes.  In even rounds a shard admits moves in a fixed order up to its quota, the mean size of a shard; in odd rounds
two shards swap as much as both want to, so full ones improve too.  Rounds end when nothing moves in two, or after ``ROUNDS``.  Hubs are a star, never pairs: a round
is a count by (hub, label), a join and a running sum.

Law ``bytes``: sizes of shards near equal.  Labelled rows beyond a quota are let go; they and rows without hub fill the
room that is left: those above a 64th of a quota, fewer than 64 a shard, go largest first to the shard
with most room; then the others by running sums, first those above a 4096th, then the rest, and at last the ``LAST``
smallest a shard one by one, which even out what came before.

Running sums have two levels, by ranges of hashes and within them, so neither a hub nor a shard is
one task; repeated rows differ by the number of their row in the written table.

Defined cases: null text has no bytes and is a text of its own; null or repeated ids are rows like others;
rows of equal text in a group larger than a quota take as few shards as fit; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

SHARDS = 24
ROUNDS = 10
#: Rows above this part of a quota are placed one by one; then come those above the second.
LARGE, MEDIUM = 64, 4096
#: The smallest rows without shard, so many a shard, are placed one by one at the end.
LAST = 32
#: Ranges of running sums: of hubs and, within them, of rows.
HUB_RANGES, ROW_RANGES = 32, 64


def upto(rows: DataFrame, by: str, key: Column, within: list[str], amount: str) -> DataFrame:
    """``rows`` with ``upto``, the running sum of ``amount`` by ``by``, in order of ``key`` (an int of few values) and ``within``."""
    keyed = rows.withColumn("__key", key)
    sums = keyed.groupBy(F.col(by).alias("__by"), F.col("__key").alias("__at")).agg(F.sum(amount).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy("__by").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    sums = sums.select("__by", "__at", before.alias("__before"))  # as many rows as labels times ranges
    inside = F.sum(amount).over(Window.partitionBy(by, "__key").orderBy(*within).rowsBetween(Window.unboundedPreceding, 0))
    placed = keyed.withColumn("__inside", inside).join(sums, (F.col(by) == F.col("__by")) & (F.col("__key") == F.col("__at")))
    return placed.withColumn("upto", F.col("__before") + F.col("__inside")).drop("__key", "__by", "__at", "__before", "__inside")


def turn(name: str, ranges: int) -> Column:
    return F.pmod(F.xxhash64(F.col(name)), F.lit(ranges)).cast("int")


def rooms(spark: SparkSession, placed: list[DataFrame], quota: int, shards: int) -> DataFrame:
    """(shard, room): a row a shard; what is left of its quota."""
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    loads = None
    for p in placed:
        sums = p.groupBy(F.col("shard").alias("__s")).agg(F.sum("size").alias("load"))
        loads = sums if loads is None else loads.unionByName(sums)
    loads = loads.groupBy("__s").agg(F.sum("load").alias("load"))
    return every.join(F.broadcast(loads), F.col("shard") == F.col("__s"), "left").select("shard", (F.lit(quota) - F.coalesce("load", F.lit(0))).alias("room"))


def propagate(rows: DataFrame, links: DataFrame, quota: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (row, size, shard, ...) with shards moved towards those of the rows that share their hubs (links: row, hub).

    Rooms are never overdrawn, swaps change a load by less than a row a pair of shards; what starts above ``quota`` is left.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "propagation")
    links = scratch.cut(links.select("row", "hub").distinct(), "links")
    now, still = scratch.cut(rows, "labels-0"), 0
    for k in range(rounds):
        room = F.broadcast(rooms(spark, [now], quota, shards))  # a row a shard
        member = links.join(now.select("row", "size", "shard"), "row")
        held = member.groupBy("hub", "shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).join(room, "shard")
        entry = F.struct((-F.col("n")).alias("order"), F.xxhash64("hub", "shard").alias("tie"), "shard", "n")
        homes = held.groupBy("hub").agg(
            F.sum(F.when(F.lit(k % 2 == 1) | (F.col("room") >= F.col("bytes") / F.col("n")), F.col("bytes"))).alias("bytes"),  # what full shards hold needs no home
            F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("counts"),  # at most as many entries as shards
            # even rounds fill shards with room, odd ones swap between full shards too
            F.sort_array(F.collect_list(F.when(F.lit(k % 2 == 1) | (F.col("room") >= F.col("bytes") / F.col("n")), entry))).alias("open"),
        )
        need = F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(quota))).cast("int")
        homes = homes.select("hub", "counts", F.slice("open", F.lit(1), need).alias("homes"))
        asks = member.join(homes, "hub").where(F.size("homes") > 0)
        # of several homes, one by the row's hash in this round
        at = F.element_at("homes", F.pmod(F.xxhash64("row", F.lit(k)), F.size("homes").cast("long")).cast("int") + 1)
        stays = F.exists("homes", lambda h: h["shard"] == F.col("shard"))
        own = F.element_at("counts", F.col("shard"))
        votes = asks.select("row", "size", "shard", "hub", F.explode(F.array(F.struct(F.col("shard").alias("to"), own.alias("n"), F.xxhash64("hub", "shard").alias("tie")), F.struct(F.when(stays, F.col("shard")).otherwise(at["shard"]).alias("to"), F.when(stays, F.lit(0)).otherwise(at["n"]).alias("n"), F.when(stays, F.lit(None)).otherwise(at["tie"]).alias("tie")))).alias("v"))
        ballot = votes.groupBy("row", "size", "shard", F.col("v.to").alias("to")).agg(F.sum("v.n").alias("n"), F.min("v.tie").alias("tie"), F.min("hub").alias("hub"))
        wish = ballot.groupBy("row", "size", "shard").agg(F.min(F.struct((-F.col("n")).alias("order"), "tie", "to", "hub")).alias("best")).select("row", "size", "shard", "best.to", "best.hub").where("to <> shard")
        key = turn("hub", HUB_RANGES) * ROW_RANGES + turn("row", ROW_RANGES)
        if k % 2 == 0:
            by, limit = "to", room.withColumnRenamed("shard", "to").withColumnRenamed("room", "limit")
        else:  # two shards swap as much as both want to
            wish = scratch.cut(wish.withColumns({"pair": F.col("shard") * shards + F.col("to"), "back": F.col("to") * shards + F.col("shard")}), f"wishes-{k}")
            flows = wish.groupBy("pair", "back").agg(F.sum("size").alias("flow"))  # at most shards squared
            back = flows.select(F.col("pair").alias("back"), F.col("flow").alias("other"))
            by, limit = "pair", flows.join(back, "back").select("pair", F.least("flow", "other").alias("limit"))
        moves = upto(wish.select("row", "size", by, "hub", *({"to"} - {by})), by, key, ["hub", "row"], "size").join(limit, by).where("upto <= limit").select("row", "to")
        moved = now.join(moves, "row", "left").withColumn("shard", F.coalesce("to", "shard")).withColumn("moved", F.col("to").isNotNull()).drop("to")
        moved = scratch.cut(moved, f"labels-{k + 1}")
        now = moved.drop("moved")
        still = still + 1 if moved.where("moved").isEmpty() else 0
        if still == 2:
            break
    return now


def one_by_one(rows: DataFrame, room: DataFrame) -> DataFrame:
    """``rows`` (row, size, ...) with the shard that has most room, largest first.  Only for a number of rows with a proven bound."""
    start = room.agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "room"))), lambda x: x["room"]).alias("room"))
    # descending by size, then ascending by number
    items = rows.agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("down"), "row"))).alias("items"))

    def place(acc: Column, x: Column) -> Column:
        at = F.array_position(acc["room"], F.array_max(acc["room"]))
        left = F.transform(acc["room"], lambda r, i: F.when(i == at - 1, r + x["down"]).otherwise(r))
        return F.struct(left.alias("room"), F.concat(acc["at"], F.array(at.cast("int") - 1)).alias("at"))

    begin = F.struct(F.col("room"), F.array().cast("array<int>").alias("at"))
    found = items.crossJoin(F.broadcast(start)).select("items", F.aggregate("items", begin, place)["at"].alias("at"))  # one row each
    found = found.select(F.explode(F.arrays_zip("items", "at")).alias("x")).select(F.col("x.items.row").alias("row"), F.col("x.at").alias("shard"))
    return rows.join(found, "row")


def by_running_sum(rows: DataFrame, room: DataFrame) -> DataFrame:
    """``rows`` (row, size, ...) with shards that get parts of them in proportion to their room."""
    positive = F.greatest("room", F.lit(0)).cast("double")
    total = F.sum(positive).over(Window.partitionBy())
    edge = F.sum(positive).over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    edges = room.select("shard", F.when(total > 0, edge / total).otherwise((F.col("shard") + 1) / F.count("*").over(Window.partitionBy())).alias("edge"))  # a row a shard
    edges = edges.agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "edge"))), lambda x: x["edge"]).alias("edges"))
    sums = upto(rows.withColumn("__one", F.lit(0)), "__one", turn("row", HUB_RANGES * ROW_RANGES), ["row"], "size").drop("__one")
    sums = sums.crossJoin(F.broadcast(edges.crossJoin(rows.agg(F.sum("size").alias("all")))))  # one row
    middle = (F.col("upto") - F.col("size") / 2) / F.col("all")
    shard = F.least(F.size(F.filter("edges", lambda e: e <= middle)), F.size("edges") - 1)
    return sums.withColumn("shard", shard.cast("int")).drop("edges", "all", "upto")


def balanced(rows: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (row, size, ...; row distinct, sizes positive) with shard and slot; ``links`` (row, hub) names hubs of rows."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "sharding")
    total = rows.agg(F.sum("size")).first()[0] or 0
    quota = -(-total // shards)
    columns = rows.columns
    linked = rows.join(links.select("row").distinct(), "row", "left_semi").withColumn("shard", turn("row", shards))
    labelled = propagate(linked, links, quota, shards, rounds)
    within = upto(labelled, "shard", turn("row", HUB_RANGES * ROW_RANGES), ["row"], "size")
    kept = scratch.cut(within.where(F.col("upto") <= quota).select(*columns, "shard"), "kept")
    free = scratch.cut(rows.join(kept.select("row"), "row", "left_anti"), "free")
    last = free.where(F.col("size") <= quota // LARGE).orderBy("size", "row").limit(LAST * shards)
    last = scratch.cut(last.select("row", F.lit(True).alias("last")), "last")
    free = free.join(last, "row", "left")
    placed = [kept]
    for name, chosen, place in (
        ("large", F.col("size") > quota // LARGE, one_by_one),  # fewer than LARGE rows a shard
        ("medium", F.col("last").isNull() & F.col("size").between(quota // MEDIUM + 1, quota // LARGE), by_running_sum),
        ("small", F.col("last").isNull() & (F.col("size") <= quota // MEDIUM), by_running_sum),
        ("last", F.col("last").isNotNull(), one_by_one),
    ):
        some = free.where(chosen).drop("last")
        placed.append(scratch.cut(place(some, rooms(spark, placed, quota, shards)).select(*columns, "shard"), name))
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    counted = upto(out.withColumn("__one", F.lit(1).cast("long")), "shard", turn("row", HUB_RANGES * ROW_RANGES), ["row"], "__one")
    return counted.withColumn("slot", F.col("upto") - 1).select(*columns, "shard", "slot")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, group_rows) of each row of ``docs`` (doc_id, text); equal texts are linked."""
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.col("text").cast("string").cast("binary")
    crc = F.coalesce(F.crc32(text), F.lit(0))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    group = F.coalesce(F.md5(text), F.lit("null"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.cast("long").alias("text_crc32"), group.alias("hub"))
    rows = scratch.cut(rows, "rows")  # the numbers are written with the rows
    groups = rows.groupBy("hub").agg(F.count("*").alias("group_rows"))
    links = rows.select("row", "hub").join(groups.where("group_rows > 1"), "hub")
    links = scratch.cut(links, "links")
    out = balanced(rows.drop("hub"), links, shards)
    out = out.join(links.select("row", "group_rows"), "row", "left")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.coalesce("group_rows", F.lit(1)).cast("long").alias("group_rows"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
