"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every document, shuffled within its source by a seeded hash, gets the virtual finish time
``cumulative source tokens / target``; copies of a source that its target wants more than once
follow with later times.  Times are sorted globally by range and cut at the total budget: the
budget's last place is found from sums of ranges, never in one task.

Targets share the budget by weight; a target stops at ``epochs`` times its source's size, and the
excess goes to the others by weight until none is above (water filling, in closed form).

Cumulative sums within a source are made in two levels, by ranges of the shuffle hash and within
them, so a source with a third of all rows is spread over all tasks.

Defined cases: null text has size 0; null source is the last source; sources without words get no
target; documents of size 0 are taken zero times; repeated rows are documents of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 3
RANGES = 4096
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    named = sizes.withColumn("weight", w).withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    named = named.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    since = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    levels = named.withColumn("level", (total - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(since))
    # the first source, by ratio, that the level does not fill ends the capped ones
    # (of equal ratios the one with the highest level, which counts the weights of them all)
    first = F.struct("ratio", (-F.col("level")).alias("down"))
    level = -F.min(F.when(F.col("ratio") >= F.col("level"), first)).over(Window.partitionBy())["down"]
    return levels.withColumn("at", level).select("source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight"))).alias("target"))


def mixed(docs: DataFrame, size: Column, seed: str = SEED, weights=WEIGHTS, epochs: int = EPOCHS, ranges: int = RANGES, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, *keys) of each row of ``docs`` (doc_id, source, ...).

    ``keys``: columns that tell rows of one id, or without id, from each other.
    """
    spark = docs.sparkSession
    from .scratch import Scratch

    scratch = Scratch(spark, "mixing")
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), *[F.concat(F.lit("null-"), F.col(k).cast("string")) for k in keys[:1]], F.lit("null"))).cast("binary"))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), digest.alias("turn"), *keys)
    rows = scratch.cut(sized.withColumn("range", F.conv(F.substring("turn", 1, 3), 16, 10).cast("int") % ranges), "rows")
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("n"))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    offsets = sums.withColumn("before", before).drop("n")
    offsets = offsets.join(plan, offsets["source"].eqNullSafe(plan["source"])).select(offsets["source"].alias("o_source"), F.col("range").alias("o_range"), "before", "source_size", "target")
    within = Window.partitionBy("source", "range").orderBy("turn", "doc_id", "size", *keys).rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.withColumn("sum", F.sum("size").over(within)).join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")))
    queued = queued.withColumn("upto", F.col("before") + F.col("sum")).select("doc_id", "source", "turn", "size", "source_size", "target", "upto", *keys)
    # copies whose finish time is at most 1 stay within every target, so all of them fit the budget
    copies = F.sequence(F.lit(0), F.lit(epochs - 1))
    finish = F.transform(copies, lambda e: (F.col("upto") + F.col("source_size") * e).cast("double") / F.col("target"))
    queued = scratch.cut(queued.withColumn("finish", F.when((F.col("target") > 0) & (F.col("size") > 0), finish).otherwise(F.array().cast("array<double>"))), "queued")
    rest = queued.select("doc_id", "source", "turn", "upto", "size", F.explode("finish").alias("at")).where("at > 1")
    cut = _cut(rest, queued, plan, scratch)
    last, upto, turn, source, doc = cut
    early = F.size(F.filter("finish", lambda x: x <= 1.0))
    if last is None:
        late = F.lit(0)
    else:
        first = F.struct(F.lit(last).alias("at"), F.lit(turn).alias("turn"), F.lit(source).alias("source"), F.lit(upto).cast("long").alias("upto"), F.lit(doc).cast("long").alias("doc_id"))
        late = F.size(
            F.filter("finish", lambda x: (x > 1.0) & (F.struct(x.alias("at"), F.col("turn"), F.coalesce("source", F.lit("\U0010ffff")).alias("source"), F.col("upto"), F.coalesce("doc_id", F.lit(-1).cast("long")).alias("doc_id")) <= first))
        )
    return queued.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target"), (F.col("size") * (early + late)).cast("long").alias("taken"), *keys)


def _cut(rest: DataFrame, queued: DataFrame, plan: DataFrame, scratch):
    """The last copy, in the global order of finish times, that fits the budget: its sort key."""
    budget = plan.agg(F.sum("source_size")).first()[0]
    if not budget:
        return (None,) * 5
    spent = queued.select((F.col("size") * F.size(F.filter("finish", lambda x: x <= 1.0))).alias("n")).agg(F.sum("n")).first()[0] or 0
    left = budget - spent
    order = ["at", "turn", "source", "upto", "doc_id"]
    keyed = rest.withColumn("source", F.coalesce("source", F.lit("\U0010ffff"))).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1).cast("long")))
    spread = scratch.cut(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "spread")
    parts = spread.groupBy("part").agg(F.sum("size").alias("n"))
    parts = parts.withColumn("upto_part", F.sum("n").over(Window.orderBy("part")))
    edge = parts.where(F.col("upto_part") > left).orderBy("part").limit(1).first()
    if edge is None:
        chosen = spread.orderBy(*[F.desc(c) for c in order]).limit(1).first()
    else:
        running = F.sum("size").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        base = edge["upto_part"] - edge["n"]
        inside = spread.where(F.col("part") == edge["part"]).withColumn("running", running + base).where(F.col("running") <= left)
        chosen = inside.orderBy(*[F.desc(c) for c in order]).limit(1).first()
        if chosen is None:  # the edge falls between two ranges
            chosen = spread.where(F.col("part") < edge["part"]).orderBy(*[F.desc(c) for c in order]).limit(1).first()
    return (None,) * 5 if chosen is None else (chosen["at"], chosen["upto"], chosen["turn"], chosen["source"], chosen["doc_id"])


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_count(F.col("text")))


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS turn FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, level DESC LIMIT 1)) AS target FROM l),
q AS (
  SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, CAST(upto + e * source_size AS DOUBLE) / target AS fin FROM q, range(0, 3) e(e) WHERE target > 0 AND size > 0),
o AS (
  SELECT doc_id, turn, size, fin, sum(size) OVER (ORDER BY (fin > 1), CASE WHEN fin > 1 THEN fin END, turn, coalesce(source, chr(1114111)), upto, doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM c),
k AS (SELECT doc_id, turn, size, count(*) AS n FROM o WHERE fin <= 1 OR spent <= (SELECT sum(source_size) FROM t) GROUP BY doc_id, turn, size)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(k.n, 0) AS BIGINT) AS taken
FROM q LEFT JOIN k ON k.doc_id = q.doc_id AND k.turn = q.turn AND k.size = q.size
"""
