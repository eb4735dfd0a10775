"""Tool-call traces and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Lower edges of the policy bands; an upper edge belongs to the next band.
BANDS = (("A", 0.0), ("B", 0.060), ("C", 0.120), ("D", 0.160), ("E", 0.300))


def replay(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """The records of a transcript's lines of JSON, as columns of ``schema``, and ``damaged``.

    A line that isn't a record, such as the last one of a run that was killed, is damaged and null in
    all columns.
    """
    parsed = lines.select(F.from_json(column, f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"}).alias("r"))
    damaged = F.col("r").isNull() | F.col("r.__bad").isNotNull()
    names = [f.name for f in T.StructType.fromDDL(schema)]
    return parsed.select(*[F.when(~damaged, F.col(f"r.{n}")).alias(n) for n in names], damaged.alias("damaged"))


def band(p: Column) -> Column:
    """Policy band of a probability; null outside of [0, 1]."""
    out = F.lit(None).cast("string")
    for name, lo in BANDS:
        out = F.when(p >= lo, F.lit(name)).otherwise(out)
    return F.when((p >= 0) & (p <= 1), out)


def band_table(spark) -> DataFrame:
    """(band, lo, hi): five rows."""
    edges = [*[lo for _, lo in BANDS[1:]], 1.0000001]
    return spark.createDataFrame([(n, lo, hi) for (n, lo), hi in zip(BANDS, edges, strict=True)], "band string, lo double, hi double")


def with_band(df: DataFrame, p: str) -> DataFrame:
    """Range join with the five bands (broadcast: a fixed table)."""
    b = band_table(df.sparkSession)
    return df.join(F.broadcast(b), (F.col(p) >= F.col("lo")) & (F.col(p) < F.col("hi")), "left").drop("lo", "hi")


def latest_ok(df: DataFrame, by: str, order: str, ok: Column, value: str, fallback: Column) -> DataFrame:
    """(by, value): the last good value, else the fallback."""
    return df.groupBy(by).agg(F.coalesce(F.max_by(F.when(ok, F.col(value)), F.when(ok, F.col(order))), F.max(fallback)).alias(value))


def dedup_first(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row of each key, by an aggregation (partial minima), not a window."""
    others = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*others), F.col(order)).alias("__r")).select(*by, "__r.*")


def tool_scores(df: DataFrame) -> DataFrame:
    """``df`` (required, optional, called) with recall, over-called tools and whether calls are exact."""
    r, o, a = F.col("required"), F.col("optional"), F.col("called")
    over = F.array_sort(F.array_except(F.array_except(a, r), o))
    recall = F.when(F.size(r) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(r, a)).cast("double") / F.size(F.array_distinct(r)))
    exact = (F.size(F.array_except(r, a)) == 0) & (F.size(over) == 0)
    return df.withColumns({"recall": recall, "over_called": over, "exact": exact})


def claim_support(claims: DataFrame, by: str) -> DataFrame:
    """Counts of claims (by, category, supported) that are normative, supported, unverified or world knowledge."""
    n, s = F.col("category") == "normative", F.col("supported")
    return claims.groupBy(by).agg(F.count_if(n).alias("normative"), F.count_if(n & s).alias("supported"), F.count_if(n & ~s).alias("unverified"), F.count_if(F.col("category") == "world").alias("world"))


def decimals(text: Column) -> Column:
    """Decimal places of a number's shortest spelling."""
    return F.length(F.regexp_extract(text, r"\.(\d+)$", 1))


def unbacked_bands(asserted: DataFrame, evidence: DataFrame) -> DataFrame:
    """Assertions (run, band, spoken) without evidence (run, band, probability) of the same band that
    rounds, half to even, to the spoken number at its own places (from 15 on: all that a double has)."""
    places = decimals(F.col("spoken"))
    rounded = F.element_at(F.array(*[F.bround(F.col("probability"), k) for k in range(16)]), F.least(places, F.lit(15)) + 1)
    e = evidence.withColumnRenamed("band", "e_band").withColumnRenamed("run", "e_run")
    return asserted.join(e, (F.col("run") == F.col("e_run")) & (F.col("band") == F.col("e_band")) & (rounded == F.col("spoken").cast("double")), "left_anti")


def expectations(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """``df`` with how many expectations are demanded and how many of those are met."""
    pairs = F.array(*[F.struct(F.col(d).alias("d"), F.col(m).alias("m")) for d, m in flags.items()])
    return df.withColumns({"demanded": F.size(F.filter(pairs, lambda p: p["d"])).cast("bigint"), "met": F.size(F.filter(pairs, lambda p: p["d"] & p["m"])).cast("bigint")})


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(a.cast("double") / F.nullif(b, F.lit(0)), F.lit(0.0))


def arm_summary(runs: DataFrame) -> DataFrame:
    """Rates of each arm over its runs that did not fail (arm, failed, supported, normative, abstained, should_abstain)."""
    ok = runs.where("NOT failed")
    a, s = F.col("abstained"), F.col("should_abstain")
    return ok.groupBy("arm").agg(
        F.count("*").alias("runs"),
        ratio(F.sum("supported"), F.sum("normative")).alias("groundedness"),
        ratio(F.count_if(a & s), F.count_if(s)).alias("abstention_recall"),
        ratio(F.count_if(a & ~s), F.count_if(~s)).alias("false_abstention"),
    )


def token_cost(df: DataFrame, prices: DataFrame, with_cache: bool = True) -> DataFrame:
    """(cost) a model: tokens times price a million; a model without price costs 0."""
    j = df.join(prices, "model", "left").na.fill(0.0, ["price_in", "price_out", "price_cached"])
    cost = F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")
    cost = cost + F.col("cached") * F.col("price_cached") if with_cache else cost
    return j.groupBy("model").agg((F.sum(cost) / 1e6).alias("cost"))


def without_completed(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is left to run."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def evidence(results: Column) -> Column:
    """Fragments of tool results: all texts of ``band_fragment`` and ``fragments`` of a JSON result."""
    schema = "band_fragment struct<text: string>, fragments array<struct<text: string>>, probability double, band string"
    r = F.from_json(results, schema)
    return F.struct(F.array_compact(F.concat(F.array(r["band_fragment"]["text"]), F.coalesce(F.transform(r["fragments"], lambda f: f["text"]), F.array().cast("array<string>")))).alias("texts"), r["probability"].alias("probability"), r["band"].alias("band"))


def rank_in_group(df: DataFrame, by: str, order: list[Column], name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
