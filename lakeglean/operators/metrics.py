"""Ranking metrics, exact under ties, from one table of distinct scores.

``curve`` is the only pass over the rows: counts by distinct score.  Cumulative sums run in two
levels, within ranges of the score and over range totals, so no window sees the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRACTICAL = 0.02
TOP_PERCENTS = (10, 30, 50)
RANGES = 64
MAXIMISE = ("pr_auc", "roc_auc", "ks", "gini", "precision_at_10", "precision_at_30", "precision_at_50", "accuracy")


class MetricError(ValueError):
    """The scored table can't be measured."""


def check_scored(df: DataFrame, y: str = "y", s: str = "s") -> None:
    """Raise unless labels are 0 or 1, both occur, and all scores are finite.  Runs one aggregation."""
    score = F.col(s).cast("double")
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    n, pos, neg, odd, wrong = df.agg(F.count("*"), F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0), F.count_if(bad), F.count_if(F.col(y).isNull() | ~F.col(y).isin(0, 1))).first()
    if not n:
        raise MetricError("no rows")
    if wrong:
        raise MetricError(f"{wrong} labels are not 0 or 1")
    if odd:
        raise MetricError(f"{odd} scores are not finite")
    if not pos or not neg:
        raise MetricError("only one class is present")


def curve(df: DataFrame, y: str = "y", s: str = "s", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., s, pos, n, cp, cn, tp, tn, tot): counts at each distinct score and from the highest down."""
    g = df.groupBy(*by, F.col(s).alias("s")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count("*").alias("n"), F.sum(F.pow(F.col(s) - F.col(y), F.lit(2.0))).alias("sq"))
    # ranges of the distinct scores, bounded by their approximate quantiles: as even for skewed scores as for others
    inner = [i / RANGES for i in range(1, RANGES)]
    extent = g.groupBy(*by).agg(F.percentile_approx("s", inner, F.lit(1000)).alias("bounds"), F.sum("pos").alias("tp"), F.sum("n").alias("tot"))
    g = g.join(extent, list(by)) if by else g.crossJoin(F.broadcast(extent))  # one row
    g = g.withColumn("part", F.size(F.filter("bounds", lambda b: b > F.col("s")))).drop("bounds")
    sums = g.groupBy(*by, "part").agg(F.sum("pos").alias("bp"), F.sum("n").alias("bn"))
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "part", F.coalesce(F.sum("bp").over(earlier), F.lit(0)).alias("op"), F.coalesce(F.sum("bn").over(earlier), F.lit(0)).alias("on_"))
    within = Window.partitionBy(*by, "part").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    out = g.join(sums, [*by, "part"]).withColumns({"cp": F.sum("pos").over(within) + F.col("op"), "cn": F.sum("n").over(within) + F.col("on_")})
    return out.select(*by, "s", "pos", "n", "sq", "cp", "cn", "tp", (F.col("tot") - F.col("tp")).alias("tn"), "tot")


def pr_auc() -> Column:
    return F.sum(F.col("pos").cast("double") / F.col("tp") * F.col("cp") / F.col("cn"))


def roc_auc() -> Column:
    neg, before = F.col("n") - F.col("pos"), F.col("cp") - F.col("pos")
    return F.sum(neg * (before + F.col("pos") / 2.0)) / F.max(F.col("tp").cast("double") * F.col("tn"))


def ks() -> Column:
    return F.greatest(F.lit(0.0), F.max(F.col("cp").cast("double") / F.col("tp") - (F.col("cn") - F.col("cp")).cast("double") / F.col("tn")))


def precision_at(percent: float) -> Column:
    """Precision in the top ``percent`` of rows; ties at the cut count at their expected value."""
    if not 0 < percent <= 100:
        raise MetricError("a share lies above 0 and up to 100 percent")
    k = F.least(F.col("tot"), F.ceil(F.col("tot") * F.lit(percent) / 100.0))
    before = F.col("cn") - F.col("n")
    here = (before < k) & (k <= F.col("cn"))
    return F.max(F.when(here, (F.col("cp") - F.col("pos") + F.col("pos") * (k - before) / F.col("n")) / k))


def accuracy(threshold: float = 0.5) -> Column:
    right = F.when(F.col("s") >= threshold, F.col("pos")).otherwise(F.col("n") - F.col("pos"))
    return F.sum(right) / F.max("tot").cast("double")


def brier() -> Column:
    return F.sum("sq") / F.max("tot")


def all_metrics(df: DataFrame, y: str = "y", s: str = "s", by: tuple[str, ...] = ()) -> DataFrame:
    """The ordered metrics, one row a group."""
    c = curve(df, y, s, by)
    grouped = c.groupBy(*by) if by else c.groupBy()
    out = grouped.agg(
        pr_auc().alias("pr_auc"),
        roc_auc().alias("roc_auc"),
        ks().alias("ks"),
        brier().alias("brier"),
        *[precision_at(p).alias(f"precision_at_{p}") for p in TOP_PERCENTS],
        accuracy().alias("accuracy"),
    )
    return out.withColumn("gini", F.col("roc_auc") * 2 - 1)


def no_signal(df: DataFrame, y: str = "y") -> DataFrame:
    """What a score without signal reaches."""
    p = F.avg(F.col(y).cast("double"))
    return df.agg(p.alias("pr_auc"), F.lit(0.5).alias("roc_auc"), F.lit(0.0).alias("ks"), F.lit(0.0).alias("gini"), (p * (1 - p)).alias("brier"), *[p.alias(f"precision_at_{k}") for k in TOP_PERCENTS], F.greatest(p, 1 - p).alias("accuracy"))


def long_form(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    parts = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in columns)
    return df.select(*keep, F.expr(f"stack({len(columns)}, {parts}) AS (metric, value)"))


def verdict(candidate: DataFrame, reference: DataFrame, least: float = PRACTICAL) -> DataFrame:
    """(metric, value, reference, delta, clears) from two long tables of metrics."""
    out = candidate.join(reference.withColumnRenamed("value", "reference"), "metric")
    return out.withColumn("delta", F.col("value") - F.col("reference")).withColumn("clears", F.abs("delta") >= least)


def fold_summary(folds: DataFrame) -> DataFrame:
    """(fold, metric, value) with rows ``mean`` and ``std`` (of a sample) added."""
    stats = folds.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    added = stats.select("metric", F.expr("stack(2, 'mean', mean, 'std', std) AS (fold, value)"))
    return folds.select(F.col("fold").cast("string").alias("fold"), "metric", "value").unionByName(added)


def paired_increment(folds: DataFrame, arm: str, base: str, metric: str) -> DataFrame:
    """Mean, standard error, t and number of positive differences of two arms over their folds."""
    m = folds.where(F.col("metric") == metric)
    a, b = (m.where(F.col("arm") == x).select("fold", F.col("value").alias(n)) for x, n in ((arm, "a"), (base, "b")))
    d = F.col("a") - F.col("b")
    out = a.join(b, "fold").agg(F.count("*").alias("folds"), F.avg(d).alias("mean"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("se"), F.count_if(d > 0).alias("positive"))
    return out.withColumn("t", F.when(F.col("se") > 0, F.col("mean") / F.col("se")))


def threshold_sweep(df: DataFrame, y: str = "y", s: str = "s", steps: int = 200, ratio: float = 5.0) -> DataFrame:
    """(threshold, tp, fp, tn, fn, cost) at each of ``steps`` + 1 thresholds, refusing at or above.

    Scores are counted by the last threshold they reach (one partial aggregation); the cumulative
    sum runs over the grid only.
    """
    step = F.floor(F.round(F.col(s) * steps, 9)).cast("int")
    at = F.greatest(F.lit(-1), F.least(F.lit(steps), step))
    counts = df.groupBy(at.alias("i")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count("*").alias("n"))
    grid = df.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("i"))
    filled = grid.join(counts, "i", "left").na.fill(0, ["pos", "n"])
    up = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    out = filled.withColumns({"tp": F.sum("pos").over(up), "above": F.sum("n").over(up), "pp": F.sum("pos").over(every), "nn": F.sum("n").over(every)}).where("i >= 0")
    fp, fn = F.col("above") - F.col("tp"), F.col("pp") - F.col("tp")
    return out.select((F.col("i") / float(steps)).alias("threshold"), "tp", fp.alias("fp"), (F.col("nn") - F.col("pp") - fp).alias("tn"), fn.alias("fn"), (F.lit(ratio) * fn + fp).alias("cost"))


def best_point(sweep: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The cheapest threshold, the highest of equally cheap ones, and its rates."""
    best = F.min_by(F.struct("threshold", "tp", "fp", "tn", "fn", "cost"), F.struct("cost", -F.col("threshold"))).alias("b")
    out = sweep.groupBy(*by).agg(best).select(*by, "b.*")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns(
        {"refused": tp + fp, "recall": F.coalesce(tp / F.nullif(tp + fn, F.lit(0)), F.lit(0.0)), "precision": F.coalesce(tp / F.nullif(tp + fp, F.lit(0)), F.lit(0.0))}
    )


def first_minimum(sweep: DataFrame, by: str) -> DataFrame:
    """The lowest of the cheapest thresholds of each group."""
    return sweep.groupBy(by).agg(F.min_by("threshold", F.struct("cost", "threshold")).alias("threshold"), F.min("cost").alias("cost"))


def representatives(df: DataFrame, key: str, s: str, threshold: float) -> DataFrame:
    """(kind, key, s): the highest, the lowest and the score closest to the threshold; first if tied."""
    row = F.struct(F.col(key).alias("k"), F.col(s).alias("s"))
    one = df.agg(F.max_by(row, F.struct(F.col(s), -F.col(key))).alias("h"), F.min_by(row, F.struct(F.col(s), F.col(key))).alias("l"), F.min_by(row, F.struct(F.abs(F.col(s) - threshold), F.col(key))).alias("b"))
    return one.select(F.expr("stack(3, 'highest', h.k, h.s, 'lowest', l.k, l.s, 'borderline', b.k, b.s) AS (kind, key, s)"))


def comparison_table(folds: DataFrame) -> DataFrame:
    """(metric, one column an arm): mean and sample deviation over folds as text."""
    stats = folds.groupBy("metric", "arm").agg(F.avg("value").alias("m"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("d"))
    return stats.withColumn("t", F.format_string("%.4f ± %.4f", "m", "d")).groupBy("metric").pivot("arm").agg(F.first("t"))


def metric_frame(folds: DataFrame) -> DataFrame:
    """(arm, one column a metric): means over folds."""
    return folds.groupBy("arm").pivot("metric").agg(F.avg("value"))
