"""Folds, samples and permutations that depend on keys and a seed only: reruns and repartitioning agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEED = 42


def draw(key: str, seed: int = SEED) -> Column:
    """A seeded pseudo-random order key of a row: hex digits, the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def stratified_folds(df: DataFrame, key: str, y: str, folds: int = 5, seed: int = SEED) -> DataFrame:
    """``df`` with ``fold`` 1..folds: each class dealt evenly in seeded order.

    Positions come from two levels (ranges of the order key, then within), so a class with most
    rows is no single task.
    """
    turn = df.withColumn("__turn", draw(key, seed)).withColumn("__part", F.substring("__turn", 1, 2))
    sums = turn.groupBy(y, "__part").agg(F.count("*").alias("__c"))
    earlier = Window.partitionBy(y).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(y).alias("__y"), F.col("__part").alias("__p"), F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy(y, "__part").orderBy("__turn", key)
    out = turn.withColumn("__n", F.row_number().over(within)).join(sums, F.col(y).eqNullSafe(F.col("__y")) & (F.col("__part") == F.col("__p")))
    return out.withColumn("fold", ((F.col("__before") + F.col("__n") - 1) % folds + 1).cast("bigint")).drop("__turn", "__part", "__c", "__y", "__p", "__before", "__n")


def exact_sample(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """Exactly n rows (all, if fewer), without replacement: sort and limit, n rows kept by each task."""
    return df.orderBy(draw(key, seed), key).limit(n)


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """``df`` with ``weight`` n / (2 * n of the row's class): two counts, broadcast."""
    counts = df.agg(F.count("*").alias("__n"), F.count_if(F.col(y) == 1).alias("__p"))
    mine = F.when(F.col(y) == 1, F.col("__p")).otherwise(F.col("__n") - F.col("__p"))
    return df.crossJoin(F.broadcast(counts)).withColumn("weight", F.col("__n") / (mine * 2.0)).drop("__n", "__p")


def permuted(df: DataFrame, key: str, y: str, seed: int) -> DataFrame:
    """``df`` with its labels shuffled: rows in key order meet labels in seeded order.

    Both sides are numbered by ranges, in parallel; the join is on the number.
    """
    from .ranking import numbered

    rows = numbered(df.drop(y), [F.col(key).asc()], "__i")
    labels = numbered(df.select(F.col(key).alias("__k"), F.col(y)), [draw("__k", seed).asc(), F.col("__k").asc()], "__i").drop("__k")
    return rows.join(labels, "__i").drop("__i")


def holdout_stream(df: DataFrame, ids: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """n seeded rows among the held-out ids."""
    return exact_sample(df.join(ids.select(key), key, "left_semi"), key, n, seed)


FAULTS = ("missing_field", "wrong_type", "unknown_code", "out_of_range")


def with_faults(df: DataFrame, key: str, percent: int = 5) -> DataFrame:
    """``df`` with ``fault``: one of four kinds for ``percent`` of rows, null for the others."""
    at = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("fault"), F.col(key).cast("string")).cast("binary")), 1, 6), 16, 10).cast("bigint")
    kind = F.element_at(F.array(*[F.lit(f) for f in FAULTS]), (F.floor(at / 100) % 4 + 1).cast("int"))
    return df.withColumn("fault", F.when(at % 100 < percent, kind))
