"""Row numbers over a whole table without a single-task window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with 0-based positions in ``order``, made by range partitioning.

    The partition of a row is fixed by writing it, so positions agree between the count and the
    numbering.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    sums = ranged.groupBy("__part").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("__part", before.alias("__before"))  # one row a partition
    within = Window.partitionBy("__part").orderBy(*order)
    return ranged.withColumn("__n", F.row_number().over(within)).join(F.broadcast(sums), "__part").withColumn(name, F.col("__before") + F.col("__n") - 1).drop("__part", "__n", "__before")


def _ranges(df: DataFrame) -> int:
    """How many ranges of a column are worked on side by side: as many as a shuffle has partitions."""
    return min(1024, max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


#: Error of the sketches that bound a quantile (one part in so many), and how far to its sides the bounds are asked for.
ACCURACY, MARGIN = 10_000, 4


def quantiles(df: DataFrame, columns: dict[str, Column], fractions: list[float], by: tuple[str, ...] = (), fixed: bool = False) -> DataFrame:
    """(``by``, an array of exact, linearly interpolated quantiles a name); null where no value is known.

    Without ``by`` there is always one row; with it one for each group that has a value.  Approximate quantiles
    bound each wanted one from both sides; a second pass counts what is below and at the bounds, and only the few
    values strictly between them are ordered.  Bounds are read from a written table, as another run of a sketch may give
    others.  Where counts show that bounds miss a quantile, all values are ordered in ranges.  Values are written
    first unless ``df`` is a written table (``fixed``).  Runs jobs.
    """
    n, m = len(columns), len(fractions)
    # a struct as the key: nulls in it are equal to each other
    rows = df.select(F.struct(F.lit(0).alias("__one"), *by).alias("__k"), *[c.cast("double").alias(f"__v{i}") for i, c in enumerate(columns.values())])
    rows = rows if fixed else written(rows, "values")
    long = _long(rows, n)
    sides = F.array(*[F.lit(min(1.0, max(0.0, f + side * MARGIN / ACCURACY))) for f in fractions for side in (-1, 1)])
    sketch = long.groupBy("__k", "i").agg(F.count("*").alias("n"), F.percentile_approx("v", sides, F.lit(ACCURACY)).alias("b"), F.array(F.min("v"), F.max("v")).alias("ends"))
    # the sides are less than a row away from each other where there are few rows
    sketch = sketch.withColumn("b", F.when(F.col("n") <= ACCURACY, F.flatten(F.array_repeat("ends", m))).otherwise(F.col("b"))).drop("ends")
    sketch = written(sketch, "bounds")  # a row a column and group
    bounded = long.join(sketch if by else F.broadcast(sketch), ["__k", "i"])
    v, lows, highs = F.col("v"), [F.col("b")[2 * j] for j in range(m)], [F.col("b")[2 * j + 1] for j in range(m)]
    counted = bounded.groupBy("__k", "i").agg(
        *[F.count_if(v < lo).alias(f"below_{j}") for j, lo in enumerate(lows)],
        *[F.count_if(v == lo).alias(f"low_{j}") for j, lo in enumerate(lows)],
        *[F.count_if((v == hi) & (hi > lo)).alias(f"high_{j}") for j, (lo, hi) in enumerate(zip(lows, highs, strict=True))],
    )
    parts = [
        F.struct(
            F.lit(j).alias("j"),
            ((F.col("n") - 1) * F.lit(float(f))).alias("place"),
            lows[j].alias("lo"),
            highs[j].alias("hi"),
            F.col(f"below_{j}").alias("below"),
            (F.col(f"below_{j}") + F.col(f"low_{j}")).alias("start"),
            F.col(f"high_{j}").alias("high"),
        )
        for j, f in enumerate(fractions)
    ]
    cell = counted.join(sketch, ["__k", "i"]).select("__k", "i", F.explode(F.array(*parts)).alias("c")).select("__k", "i", "c.*")
    cell = written(cell, "cells")  # a row a quantile
    inside = [(v > lo) & (v < hi) for lo, hi in zip(lows, highs, strict=True)]
    inner = bounded.where(reduce(Column.__or__, inside)).select("__k", "i", "v", F.explode(F.array(*[F.when(x, F.lit(j)) for j, x in enumerate(inside)])).alias("j"))
    inner = inner.where("j IS NOT NULL").groupBy("__k", "i", "j", "v").agg(F.count("*").alias("__c"))
    within = Window.partitionBy("__k", "i", "j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inner = inner.withColumn("__upto", F.sum("__c").over(within))
    low, high = (f("place") - F.col("start") for f in (F.floor, F.ceil))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("__upto") > place) & (F.col("__upto") - F.col("__c") <= place), F.col("v")))

    found = inner.join(cell, ["__k", "i", "j"]).groupBy("__k", "i", "j").agg(at(low).alias("l"), at(high).alias("h"), F.max("__upto").alias("between"))
    whole = cell.join(found, ["__k", "i", "j"], "left").withColumn("between", F.coalesce("between", F.lit(0)))

    def value(index: Column, inside: str) -> Column:
        """Null if the bounds miss it."""
        after = F.col("start") + F.col("between")
        out = F.when((index >= F.col("below")) & (index < F.col("start")), F.col("lo")).when((index >= F.col("start")) & (index < after), F.col(inside))
        return out.when((index >= after) & (index < after + F.col("high")), F.col("hi"))

    p = F.col("place")
    ends = whole.select("__k", "i", "j", "place", value(F.floor(p), "l").alias("l"), value(F.ceil(p), "h").alias("h"))
    ends = written(ends, "quantiles")  # a row a quantile
    if not ends.where("l IS NULL OR h IS NULL").isEmpty():
        ends = _ends_by_ranges(rows, n, fractions)
    q = F.when(F.col("l") == F.col("h"), F.col("l")).otherwise((F.ceil(p) - p) * F.col("l") + (p - F.floor(p)) * F.col("h"))
    each = ends.select(*[F.col(f"__k.{c}").alias(c) for c in by], "i", "j", q.alias("q"))
    each = each.groupBy(*by, "i").agg(F.array(*[F.max(F.when(F.col("j") == j, F.col("q"))) for j in range(m)]).alias("q"))
    return each.groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(name) for i, name in enumerate(columns)])


def _long(rows: DataFrame, n: int) -> DataFrame:
    """(__k, i, v): a row a known value."""
    return rows.select("__k", F.expr(f"stack({n}, {', '.join(f'{i}, __v{i}' for i in range(n))}) AS (i, v)")).where("v IS NOT NULL")


def _ends_by_ranges(rows: DataFrame, n: int, fractions: list[float]) -> DataFrame:
    """(__k, i, j, place, l, h): both neighbours of each quantile's place in the ordered values of ``rows`` (__k, __v0, ...).

    Values are counted first; ranges of the distinct ones, bounded by approximate quantiles, are ordered side by
    side, and a neighbour is read off where the running count passes its position.  The range of a value is
    written, so that it is the same in the sums and in the order.
    """
    long = _long(rows, n)
    counts = long.groupBy("__k", "i", "v").agg(F.count("*").alias("c"))
    ranges = _ranges(rows)
    inner = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    bounds = counts.groupBy("__k", "i").agg(F.percentile_approx("v", inner, F.lit(max(1000, 10 * ranges))).alias("bounds"), F.sum("c").alias("total"))
    parted = written(counts.join(bounds, ["__k", "i"]).withColumn("part", F.size(F.filter("bounds", lambda b: b < F.col("v")))).drop("bounds"), "ranges")
    earlier = Window.partitionBy("__k", "i").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parted.groupBy("__k", "i", "part").agg(F.sum("c").alias("s"))
    offsets = offsets.select("__k", "i", "part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before"))  # a row a range
    within = Window.partitionBy("__k", "i", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = parted.withColumn("upto", F.sum("c").over(within)).join(offsets, ["__k", "i", "part"]).withColumn("upto", F.col("upto") + F.col("before"))
    places = F.array(*[(F.col("total") - 1) * F.lit(float(f)) for f in fractions])
    placed = placed.select("__k", "i", "v", "c", "upto", F.posexplode(places).alias("j", "place"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place), F.col("v")))

    return placed.groupBy("__k", "i", "j", "place").agg(at(F.floor("place")).alias("l"), at(F.ceil("place")).alias("h"))


def running(df: DataFrame, order: str, sums: dict[str, str], ranges: int | None = None) -> DataFrame:
    """``df`` with running sums (new name: column) in ascending order of a numeric column of distinct values.

    Ranges of that column, bounded by its approximate quantiles (one broadcast row), are summed
    first; a window then runs within ranges only, so no task sees the whole table.  The range of a row is
    written, as another run of the approximation may give another one.  Runs jobs.
    """
    ranges = ranges or _ranges(df)
    q = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    bounds = df.agg(F.percentile_approx(order, q, F.lit(1000)).alias("__bounds"))
    parted = df.crossJoin(F.broadcast(bounds)).withColumn("__part", F.size(F.filter(F.coalesce("__bounds", F.array()), lambda b: b < F.col(order)))).drop("__bounds")
    parted = written(parted, "running")
    totals = parted.groupBy("__part").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in sums])  # one row a range
    within = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = parted.withColumns({n: F.sum(c).over(within) for n, c in sums.items()}).join(F.broadcast(offsets), "__part")
    return out.withColumns({n: F.col(n) + F.col(f"__o_{n}") for n in sums}).drop("__part", *[f"__o_{n}" for n in sums])
