"""Group profiles: one aggregation each, with exact quantiles and explicit subtotals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as N
from ..sources.shared import written
from .ranking import quantiles, running

AGE_EDGES = [20, 29, 39, 49, 120]
AGE_LABELS = ["21-29", "30-39", "40-49", "50-120"]
MIN_GROUP = 500


def share(test: Column) -> Column:
    return F.avg(test.cast("double"))


def amount_profile(df: DataFrame, code: str, amount: str, target: str) -> DataFrame:
    """Per code and in all (code null, is_total 1): rows, share of the table, target rate, quantiles."""
    out = df.rollup(code).agg(
        F.grouping(code).cast("int").alias("is_total"),
        F.count("*").alias("rows"),
        F.avg(target).alias("rate"),
        F.min(amount).alias("least"),
        F.max(amount).alias("greatest"),
        share(F.col(amount) == 0).alias("share_zero"),
        share(F.col(amount) <= 0).alias("share_not_positive"),
    )
    total = F.max(F.when(F.col("is_total") == 1, F.col("rows"))).over(Window.partitionBy())
    thirds, value = [0.25, 0.5, 0.75], {"q": F.col(amount)}
    each = quantiles(df, value, thirds, (code,)).select(F.col(code).alias("__code"), F.lit(0).alias("__total"), "q")
    every = quantiles(df, value, thirds).select(F.lit(None).cast(df.schema[code].dataType).alias("__code"), F.lit(1).alias("__total"), "q")
    q = each.unionByName(every)
    out = out.withColumn("share", F.col("rows") / total).join(q, F.col(code).eqNullSafe(F.col("__code")) & (F.col("is_total") == F.col("__total")), "left").drop("__code", "__total")
    return out.withColumns({"p25": F.col("q")[0], "p50": F.col("q")[1], "p75": F.col("q")[2]}).drop("q")


def coverage(df: DataFrame, code: str, paid: str, billed: str) -> DataFrame:
    """Per code: median of paid / billed where something was billed, and the share left out.

    The floor here is 0, not the features' 100.
    """
    ratio = F.when(F.col(billed) > 0, F.col(paid).cast("double") / F.col(billed))
    median = quantiles(df, {"q": ratio}, [0.5], (code,)).select(F.col(code).alias("__code"), F.col("q")[0].alias("median_coverage"))
    out = df.groupBy(code).agg(share(F.col(billed) <= 0).alias("excluded_share"), F.count("*").alias("rows"))
    return out.join(median, F.col(code).eqNullSafe(F.col("__code")), "left").select(code, "median_coverage", "excluded_share", "rows")


def code_month_matrix(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Counts of each code in each month, missing ones 0: unpivot, then one pivot aggregation."""
    parts = ", ".join(f"'{name}', `{c}`" for c, name in columns.items())
    long = df.select(F.expr(f"stack({len(columns)}, {parts}) AS (month, code)"))
    return long.groupBy("code").pivot("month", list(columns.values())).count().na.fill(0)


def transitions(df: DataFrame, before: str, after: str) -> DataFrame:
    """(before, after, n, share): shares add up to 1 for each code before."""
    n = df.groupBy(F.col(before).alias("before"), F.col(after).alias("after")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("before")))


def average_ranks(df: DataFrame, value: str, name: str, many: bool = False) -> DataFrame:
    """``df`` with the rank of a column, ties sharing their mean rank.

    Ranks come from the counts of distinct values, so the ordered pass is over those, not over rows;
    with ``many`` distinct values it runs within ranges of them.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    if many:
        counts = running(counts, value, {"__upto": "__n"})
    else:
        counts = counts.withColumn("__upto", F.sum("__n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    ranks = counts.select(F.col(value).alias("__v"), (F.col("__upto") - (F.col("__n") - 1) / 2.0).alias(name))
    return df.join(ranks, F.col(value) == F.col("__v"), "left").drop("__v")


#: Distinct values, of all columns together, whose ranks are broadcast.
LEVELS = 1000


def spearman(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, rho): Pearson correlation of average ranks of each pair of columns.  Runs a job.

    Values of all columns are counted in one pass.  Codes have few: their ranks become one broadcast row, and a
    second pass correlates.  Beyond ``LEVELS`` values each column's ranks are made in ranges and joined.
    """
    columns = sorted({c for p in pairs for c in p})
    entries = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])
    counts = df.select(F.explode(entries).alias("e")).select("e.c", "e.v").where("v IS NOT NULL").groupBy("c", "v").agg(F.count("*").alias("n"))
    counts = written(counts, "levels")
    if counts.count() > LEVELS:
        ranked = df.select(*columns)
        for c in columns:
            ranked = average_ranks(ranked, c, f"__r_{c}", many=True)
    else:
        upto = F.sum("n").over(Window.partitionBy("c").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))  # the levels of a column
        ranks = counts.select("c", F.struct("v", (upto - (F.col("n") - 1) / 2.0).alias("rank")).alias("e"))
        maps = ranks.agg(*[F.map_from_entries(F.collect_list(F.when(F.col("c") == c, F.col("e")))).alias(f"__m_{i}") for i, c in enumerate(columns)])
        ranked = df.select(*columns).crossJoin(F.broadcast(maps))  # one row
        ranked = ranked.select(*[F.try_element_at(F.col(f"__m_{i}"), F.col(c).cast("double")).alias(f"__r_{c}") for i, c in enumerate(columns)])
    one = ranked.agg(*[F.corr(f"__r_{a}", f"__r_{b}").alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    parts = ", ".join(f"'{a}', '{b}', c{i}" for i, (a, b) in enumerate(pairs))
    return one.select(F.expr(f"stack({len(pairs)}, {parts}) AS (a, b, rho)"))


def documented_profile(df: DataFrame, level: str, documented: Column, target: str) -> DataFrame:
    """Rows and rate of each level, of documented and undocumented ones, and of all."""
    g = df.withColumn("documented", documented).withColumn("level", F.col(level))
    return g.groupingSets([["level", "documented"], ["documented"], []], "level", "documented").agg(F.grouping_id().cast("bigint").alias("gid"), F.count("*").alias("rows"), F.avg(target).alias("rate"))


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, skew, kurtosis, iqr_over_std): bias-corrected skewness and excess kurtosis."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.count(x).cast("double").alias(f"n{i}"), F.skewness(x).alias(f"g{i}"), F.kurtosis(x).alias(f"k{i}"), F.stddev_pop(x).alias(f"s{i}")]
    parts = ", ".join(f"'{c}', n{i}, g{i}, k{i}, q{i}, s{i}" for i, c in enumerate(columns))
    q = quantiles(df, {f"q{i}": F.col(c) for i, c in enumerate(columns)}, [0.25, 0.75])
    one = df.agg(*aggs).crossJoin(F.broadcast(q)).select(F.expr(f"stack({len(columns)}, {parts}) AS (column, n, g, k, q, s)"))  # one row each
    n = F.col("n")
    skew = F.when(n > 2, F.col("g") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("k") + 6))
    width = F.col("q")[1] - F.col("q")[0]
    return one.select("column", skew.alias("skew"), kurt.alias("kurtosis"), F.when(F.col("s") > 0, width / F.col("s")).alias("iqr_over_std"))


def correlated_pairs(df: DataFrame, columns: list[str], least: float = 0.9) -> DataFrame:
    """(a, b, r) of the column pairs whose |r| reaches ``least``: one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    parts = ", ".join(f"'{a}', '{b}', c{i}" for i, (a, b) in enumerate(pairs))
    return one.select(F.expr(f"stack({len(pairs)}, {parts}) AS (a, b, r)")).where(F.abs("r") >= least)


def quantile_edges(df: DataFrame, value: str, bins: int, by: str | None = None) -> DataFrame:
    """One row (edges) a group: distinct linear quantiles, ascending."""
    q = quantiles(df, {"__q": F.col(value)}, [i / bins for i in range(bins + 1)], (by,) if by else ())
    return q.select(*([by] if by else []), F.coalesce(F.array_distinct("__q"), F.array().cast("array<double>")).alias("edges"))


def quantile_bins(df: DataFrame, value: str, bins: int, by: str | None = None) -> DataFrame:
    """``df`` with ``bin``: number of inner edges below the value (right-closed bins)."""
    edges = quantile_edges(df, value, bins, by)
    joined = df.join(edges, by) if by else df.crossJoin(F.broadcast(edges))  # one row
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    return joined.withColumn("bin", F.size(F.filter(inner, lambda e: F.col(value) > e)).cast("bigint")).drop("edges")


def reliability(df: DataFrame, y: str, s: str, bins: int = 10, by: str | None = None) -> DataFrame:
    """Mean prediction, observed rate and gap of each filled quantile bin."""
    keys = [by, "bin"] if by else ["bin"]
    out = quantile_bins(df, s, bins, by).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(s).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"))
    return out.withColumn("gap", F.col("observed") - F.col("predicted"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, mean, p25, p50, p75, greatest), exact."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.max(x).alias(f"x{i}")]
    parts = ", ".join(f"'{c}', n{i}, m{i}, q{i}, x{i}" for i, c in enumerate(columns))
    q = quantiles(df, {f"q{i}": F.col(c) for i, c in enumerate(columns)}, [0.25, 0.5, 0.75])
    one = df.agg(*aggs).crossJoin(F.broadcast(q))  # one row each
    return one.select(F.expr(f"stack({len(columns)}, {parts}) AS (column, n, mean, q, greatest)")).select("column", "n", "mean", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "greatest")


def top_overlap(df: DataFrame, key: str, a: str, b: str, percent: int = 10) -> DataFrame:
    """(k, overlap): share of the top k rows by ``a`` that are among the top k by ``b``.

    Top k by sort and limit (each task keeps its own k), not by a window over all rows.
    """
    k = max(1, df.count() * percent // 100)
    tops = [df.orderBy(F.desc(c), key).limit(k).select(key) for c in (a, b)]
    return tops[0].join(tops[1], key).agg(F.lit(k).cast("bigint").alias("k"), (F.count("*") / F.lit(float(k))).alias("overlap"))


def rank_shift(df: DataFrame, a: str, b: str) -> DataFrame:
    """Median of |average rank by a - average rank by b|."""
    ranked = average_ranks(average_ranks(df.select(a, b), a, "__ra", many=True), b, "__rb", many=True)
    return quantiles(ranked, {"q": F.abs(F.col("__ra") - F.col("__rb"))}, [0.5]).select(F.col("q")[0].alias("median_shift"))


def group_outcomes(df: DataFrame, group: str, y: str, refused: str, least: int = MIN_GROUP) -> DataFrame:
    """Outcomes of each group; rates are null where their subset is empty."""
    p, r = F.col(y) == 1, F.col(refused).cast("double")
    out = df.groupBy(group).agg(
        F.count("*").alias("n"),
        F.avg(r).alias("refusal_rate"),
        F.avg(F.col(y).cast("double")).alias("base_rate"),
        F.avg(F.when(~p, r)).alias("fpr"),
        F.avg(F.when(p, r)).alias("tpr"),
        F.avg(F.when(p, 1 - r)).alias("fnr"),
    )
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).withColumn("supports_conclusion", F.col("n") >= least)


def disparity(outcomes: DataFrame) -> DataFrame:
    """Gaps over the groups that support a conclusion; no row if fewer than two do."""
    gaps = [(F.max(c) - F.min(c)).alias(f"{c}_gap") for c in ("refusal_rate", "fpr", "tpr", "fnr")]
    ratio = F.min("refusal_rate") / F.nullif(F.max("refusal_rate"), F.lit(0.0))
    return outcomes.where("supports_conclusion").agg(F.count("*").alias("groups"), *gaps, ratio.alias("impact_ratio")).where("groups >= 2")


def attribute_gaps(df: DataFrame, attributes: dict[str, Column], y: str, refused: str, by: tuple[str, ...] = (), least: int = MIN_GROUP) -> DataFrame:
    """(*by, attribute, groups, gaps): ``disparity`` of many attributes from one aggregation.

    Each row counts once for each attribute, in partial sums before the shuffle.  A null is a group like any
    other; an attribute with fewer than two groups of ``least`` rows has no row.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("attribute"), v.cast("string").alias("group")) for k, v in attributes.items()])
    p, r = F.col("__y") == 1, F.col("__r")
    rows = df.select(*by, F.col(y).alias("__y"), F.col(refused).cast("double").alias("__r"), F.explode(pairs).alias("a"))
    groups = rows.groupBy(*by, F.col("a.attribute").alias("attribute"), F.col("a.group").alias("group")).agg(
        F.count("*").alias("n"),
        F.avg(r).alias("refusal_rate"),
        F.avg(F.col("__y").cast("double")).alias("base_rate"),
        F.avg(F.when(~p, r)).alias("fpr"),
        F.avg(F.when(p, r)).alias("tpr"),
    )
    gaps = [(F.max(c) - F.min(c)).alias(f"{c}_gap") for c in ("refusal_rate", "base_rate", "fpr", "tpr")]
    ratio = F.min("refusal_rate") / F.nullif(F.max("refusal_rate"), F.lit(0.0))
    return groups.where(F.col("n") >= least).groupBy(*by, "attribute").agg(F.count("*").alias("groups"), *gaps, ratio.alias("impact_ratio")).where("groups >= 2")


def age_band(age: Column) -> Column:
    return N.right_closed(age, AGE_EDGES, AGE_LABELS, "nan")


def length_histogram(df: DataFrame, length: str, edges: list[int]) -> DataFrame:
    """(bucket, n): left-closed, the last one open to the top."""
    return df.groupBy(N.left_closed_index(F.col(length), edges).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


def order_statistics(df: DataFrame, value: str, fractions: dict[str, float], rounding: str = "half_even") -> DataFrame:
    """One row: the value at index round(fraction * (n - 1)) of the sorted values.

    Positions come from counts of distinct values, so the ordered pass is over those, not over rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("total"))
    placed = running(counts, value, {"upto": "c"}).crossJoin(F.broadcast(total))  # one row

    def index(f: float) -> Column:
        at = (F.col("total") - 1) * F.lit(f)
        return F.bround(at, 0) if rounding == "half_even" else F.floor(at + 0.5)

    return placed.agg(*[F.max(F.when((F.col("upto") > index(f)) & (F.col("upto") - F.col("c") <= index(f)), F.col(value))).alias(name) for name, f in fractions.items()])
