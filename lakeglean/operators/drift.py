"""Population drift: stability index over frozen reference bins, and the two-sample statistic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import quantiles, running

EPSILON = 1e-6
MODERATE, SIGNIFICANT = 0.10, 0.25
BINS = 10


class DriftError(ValueError):
    """A sample is empty, or nothing can be compared."""


def reference_edges(ref: DataFrame, value: str, bins: int = BINS) -> list[float]:
    """Inner edges of the reference's quantile bins; none for a constant column.  Runs one job."""
    edges = quantiles(ref, {"q": F.col(value)}, [i / bins for i in range(bins + 1)]).first()["q"]
    if edges is None:
        raise DriftError("the reference is empty")
    return sorted(set(edges))[1:-1]


def _index(counts: DataFrame) -> DataFrame:
    """(psi) from (ref, served) counts of each bin."""
    every = Window.partitionBy()
    a, b = (F.greatest(F.coalesce(F.try_divide(F.col(c), F.sum(c).over(every)), F.lit(0.0)), F.lit(EPSILON)) for c in ("ref", "served"))
    return counts.withColumns({"a": a, "b": b}).agg(F.sum((F.col("b") - F.col("a")) * F.log(F.col("b") / F.col("a"))).alias("psi"))


def psi_numeric(ref: DataFrame, served: DataFrame, value: str, bins: int = BINS) -> DataFrame:
    """One row (psi): left-closed bins between the reference's distinct quantiles; empty bins count."""
    edges = reference_edges(ref, value, bins)
    at = sum([(F.col(value) >= F.lit(e)).cast("int") for e in edges], F.lit(0))
    both = ref.select(at.alias("bin"), F.lit(1).alias("r"), F.lit(0).alias("s")).unionByName(served.select(at.alias("bin"), F.lit(0).alias("r"), F.lit(1).alias("s")))
    counts = both.where("bin IS NOT NULL").groupBy("bin").agg(F.sum("r").alias("ref"), F.sum("s").alias("served"))
    grid = ref.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    return _index(grid.join(counts, "bin", "left").na.fill(0, ["ref", "served"]))


def psi_categorical(ref: DataFrame, served: DataFrame, value: str, declared: list = ()) -> DataFrame:
    """One row (psi): levels are the declared and the reference's; levels served only fall out."""
    r = ref.groupBy(value).agg(F.count("*").alias("ref")).where(F.col(value).isNotNull())
    s = served.groupBy(value).agg(F.count("*").alias("served"))
    levels = r.select(value)
    if declared:
        levels = levels.unionByName(ref.sparkSession.createDataFrame([(d,) for d in declared], levels.schema)).distinct()
    return _index(levels.join(r, value, "left").join(s, value, "left").na.fill(0, ["ref", "served"]))


def ks_two_sample(ref: DataFrame, served: DataFrame, value: str) -> DataFrame:
    """One row (ks, n_ref, n_served): largest gap of the two distribution functions."""
    both = ref.select(F.col(value).alias("v"), F.lit(1).alias("r"), F.lit(0).alias("s")).unionByName(served.select(F.col(value).alias("v"), F.lit(0).alias("r"), F.lit(1).alias("s")))
    g = both.where("v IS NOT NULL").groupBy("v").agg(F.sum("r").alias("a"), F.sum("s").alias("b"))
    totals = g.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    w = running(g, "v", {"ca": "a", "cb": "b"}).crossJoin(F.broadcast(totals))  # one row
    return w.agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("ks"), F.max("na").alias("n_ref"), F.max("nb").alias("n_served"))


#: Samples whose sizes multiply to no more than this get the exact p-value.
EXACT_UP_TO = 10_000


def ks_p_value(ks: float, n: int, m: int, terms: int = 100, exact_up_to: int = EXACT_UP_TO) -> float:
    """Two-sided p-value of the statistic of samples of n and m rows.

    Exact where n * m <= ``exact_up_to`` and no value is tied: of all orders of the two samples, which are paths on a
    lattice, the share that is somewhere as far from the diagonal.  Else asymptotic, by Kolmogorov's series.
    """
    if n < 1 or m < 1:
        raise DriftError("a sample is empty")
    if n * m <= exact_up_to:
        return exact_p_value(round(ks * n * m), n, m)
    root = math.sqrt(n * m / (n + m))
    x = (root + 0.12 + 0.11 / root) * ks
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, terms + 1))))


def exact_p_value(gap: int, n: int, m: int) -> float:
    """Share of the lattice paths from (0, 0) to (n, m) that reach a point (i, j) with |i m - j n| >= ``gap``: whole numbers, row by row."""
    if gap <= 0:
        return 1.0
    inside = [int(j * n < gap) for j in range(m + 1)]
    for j in range(1, m + 1):
        inside[j] &= inside[j - 1]
    for i in range(1, n + 1):
        for j in range(m + 1):
            inside[j] = (inside[j] + (inside[j - 1] if j else 0)) if abs(i * m - j * n) < gap else 0
    paths = math.comb(n + m, n)
    return (paths - inside[m]) / paths


def ks_test(ref: DataFrame, served: DataFrame, value: str) -> DataFrame:
    """One row (ks, n_ref, n_served, p_value).  Runs a job that ends in one row."""
    row = ks_two_sample(ref, served, value).first()
    if not row["n_ref"] or not row["n_served"]:
        raise DriftError("a sample is empty")
    p = ks_p_value(row["ks"], row["n_ref"], row["n_served"])
    return ref.sparkSession.createDataFrame([(row["ks"], row["n_ref"], row["n_served"], p)], "ks double, n_ref bigint, n_served bigint, p_value double")


def band(psi: Column) -> Column:
    return F.when(psi >= SIGNIFICANT, "significant").when(psi >= MODERATE, "moderate").otherwise("none")


def summary(report: DataFrame) -> DataFrame:
    """One row from (feature, psi): how many features, the greatest index, how many drifted, and their names."""
    drifted = F.col("psi") >= MODERATE
    return report.agg(F.count("*").alias("features"), F.max("psi").alias("greatest"), F.count_if(drifted).alias("drifted"), F.array_join(F.array_sort(F.collect_set(F.when(drifted, F.col("feature")))), ",").alias("names"))


def report(ref: DataFrame, served: DataFrame, numeric: list[str], categorical: list[str], declared: dict | None = None) -> DataFrame:
    """(feature, kind, psi, band) of the shared columns, the most drifted first."""
    shared = [c for c in (*numeric, *categorical) if c in ref.columns and c in served.columns]
    if not shared:
        raise DriftError("no shared column")
    if ref.isEmpty() or served.isEmpty():
        raise DriftError("a sample is empty")
    numbers = [c for c in shared if c in numeric]
    names = [c for c in shared if c not in numeric]
    counts = []
    if numbers:
        # edges of all features in one call, bins of all features in one pass
        edges = quantiles(ref, {c: F.col(c) for c in numbers}, [i / BINS for i in range(BINS + 1)]).first()
        if empty := [c for c in numbers if edges[c] is None]:
            raise DriftError(f"the reference is empty: {', '.join(empty)}")
        inner = {c: sorted(set(edges[c]))[1:-1] for c in numbers}
        at = {c: sum([(F.col(c) >= F.lit(e)).cast("int") for e in inner[c]], F.when(F.col(c).isNotNull(), 0)) for c in numbers}
        grid = ref.sparkSession.createDataFrame([(c, str(i)) for c in numbers for i in range(len(inner[c]) + 1)], "feature string, bin string")
        counts.append(_both(ref, served, {c: x.cast("string") for c, x in at.items()}, grid))
    if names:
        counts.append(_both(ref, served, {c: F.col(c).cast("string") for c in names}, None, declared or {}))
    out = None
    for kind, part in zip(["numeric"] * bool(numbers) + ["categorical"] * bool(names), counts, strict=True):
        one = part.select("feature", F.lit(kind).alias("kind"), "psi", band(F.col("psi")).alias("band"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("psi"), "feature")


def _both(ref: DataFrame, served: DataFrame, bins: dict[str, Column], grid: DataFrame | None, declared: dict | None = None) -> DataFrame:
    """(feature, psi) from one pass over both samples; bins are those of ``grid``, or the reference's levels and the declared ones."""

    def long(df: DataFrame, r: int) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(c).alias("feature"), x.alias("bin")) for c, x in bins.items()])
        return df.select(F.explode(entries).alias("e"), F.lit(r).alias("r")).select("e.feature", "e.bin", "r").where("bin IS NOT NULL")

    counts = long(ref, 1).unionByName(long(served, 0)).groupBy("feature", "bin").agg(F.sum("r").alias("ref"), F.count_if(F.col("r") == 0).alias("served"))
    if grid is not None:
        counts = F.broadcast(grid).join(counts, ["feature", "bin"], "left").na.fill(0, ["ref", "served"])
    else:
        more = [(c, str(v)) for c, values in declared.items() if c in bins for v in values]
        if more:
            extra = ref.sparkSession.createDataFrame(more, "feature string, bin string").select("feature", "bin", F.lit(0).cast("bigint").alias("ref"), F.lit(0).cast("bigint").alias("served"), F.lit(True).alias("told"))
            counts = counts.withColumn("told", F.lit(False)).unionByName(extra).groupBy("feature", "bin").agg(F.sum("ref").alias("ref"), F.sum("served").alias("served"), F.bool_or("told").alias("told"))
            counts = counts.where("ref > 0 OR told").drop("told")
        else:
            counts = counts.where("ref > 0")
    every = Window.partitionBy("feature")  # a row a bin
    a, b = (F.greatest(F.coalesce(F.try_divide(F.col(c), F.sum(c).over(every)), F.lit(0.0)), F.lit(EPSILON)) for c in ("ref", "served"))
    return counts.withColumns({"a": a, "b": b}).groupBy("feature").agg(F.sum((F.col("b") - F.col("a")) * F.log(F.col("b") / F.col("a"))).alias("psi"))
