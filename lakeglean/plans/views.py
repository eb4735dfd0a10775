"""Stand-in views: the credit table, scores, logs and corpora made from the test tables, in Spark and
in SQL.  The SQL is written on its own and serves as oracle input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a customer: ID, the 23 predictors and the target, all bigint.

    Orders are summed by customer and month in one pivot aggregation (partial sums, one shuffle on the
    customer key that the join reuses).
    """
    o = table(spark, sf_dir, "orders")
    m = 2002 - F.year("o_orderdate")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    aggs = []
    for k in range(1, 7):
        here = F.col("m") == k
        aggs += [
            F.coalesce(F.sum(F.when(here, cents)), F.lit(0)).alias(f"b{k}"),
            F.coalesce(F.sum(F.when(here & (F.col("o_orderstatus") == "F"), cents)), F.lit(0)).alias(f"p{k}"),
            F.count_if(here).alias(f"n{k}"),
            F.count_if(here & (F.col("o_orderstatus") == "P")).alias(f"s{k}"),
        ]
    by = o.select("o_custkey", m.alias("m"), "o_totalprice", "o_orderstatus").groupBy("o_custkey").agg(*aggs)
    c = table(spark, sf_dir, "customer").join(by, F.col("c_custkey") == F.col("o_custkey"), "left")
    k = F.col("c_custkey")

    def whole(x):
        return F.coalesce(F.expr(f"{x} div 100"), F.lit(0)).cast("bigint")

    return c.select(
        k.alias("ID"),
        F.floor("c_acctbal").cast("bigint").alias("LIMIT_BAL"),
        (k % 2 + 1).cast("bigint").alias("SEX"),
        (F.col("c_nationkey") % 7).cast("bigint").alias("EDUCATION"),
        (k % 4).cast("bigint").alias("MARRIAGE"),
        (18 + k % 60).cast("bigint").alias("AGE"),
        *[F.when(F.coalesce(F.col(f"n{i}"), F.lit(0)) == 0, -2).otherwise(F.col(f"s{i}") - 1).cast("bigint").alias(f"PAY_STATUS_{i}") for i in range(1, 7)],
        *[whole(f"b{i}").alias(f"BILL_AMT{i}") for i in range(1, 7)],
        *[whole(f"p{i}").alias(f"PAY_AMT{i}") for i in range(1, 7)],
        F.when((k * 7919) % 100 < 22, 1).otherwise(0).cast("bigint").alias("DEFAULT_PAYMENT_NEXT_MONTH"),
    )


def _panel_sql() -> str:
    aggs, cols = [], []
    for k in range(1, 7):
        here = f"2002 - year(o_orderdate) = {k}"
        cents = "CAST(round(o_totalprice * 100) AS BIGINT)"
        aggs += [
            f"coalesce(sum({cents}) FILTER ({here}), 0) AS b{k}",
            f"coalesce(sum({cents}) FILTER ({here} AND o_orderstatus = 'F'), 0) AS p{k}",
            f"count(*) FILTER ({here}) AS n{k}",
            f"count(*) FILTER ({here} AND o_orderstatus = 'P') AS s{k}",
        ]
    cols += [f"CAST(CASE WHEN coalesce(n{i}, 0) = 0 THEN -2 ELSE s{i} - 1 END AS BIGINT) AS PAY_STATUS_{i}" for i in range(1, 7)]
    cols += [f"CAST(coalesce(b{i} // 100, 0) AS BIGINT) AS BILL_AMT{i}" for i in range(1, 7)]
    cols += [f"CAST(coalesce(p{i} // 100, 0) AS BIGINT) AS PAY_AMT{i}" for i in range(1, 7)]
    return f"""SELECT c_custkey AS ID, CAST(floor(c_acctbal) AS BIGINT) AS LIMIT_BAL, CAST(c_custkey % 2 + 1 AS BIGINT) AS SEX, CAST(c_nationkey % 7 AS BIGINT) AS EDUCATION,
  CAST(c_custkey % 4 AS BIGINT) AS MARRIAGE, CAST(18 + c_custkey % 60 AS BIGINT) AS AGE, {', '.join(cols)},
  CAST(CASE WHEN (c_custkey * 7919) % 100 < 22 THEN 1 ELSE 0 END AS BIGINT) AS DEFAULT_PAYMENT_NEXT_MONTH
  FROM customer LEFT JOIN (SELECT o_custkey, {', '.join(aggs)} FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey"""


PANEL = f"panel AS ({_panel_sql()})"

_UTIL = ", ".join(f"CASE WHEN LIMIT_BAL > 100 THEN CAST(BILL_AMT{m} AS DOUBLE) / LIMIT_BAL END AS UTILIZATION_M{m}" for m in range(1, 7))
_RATIO = ", ".join(f"CASE WHEN BILL_AMT{m + 1} > 100 THEN CAST(PAY_AMT{m} AS DOUBLE) / BILL_AMT{m + 1} END AS PAYMENT_RATIO_M{m}" for m in range(2, 6))
_FLAGS = ", ".join(f"CAST(BILL_AMT{m + 1} <= 100 AS BIGINT) AS PAYMENT_RATIO_NOT_COMPUTABLE_M{m}" for m in range(2, 6))
PANEL_WIDE = f"{PANEL}, wide AS (SELECT *, {_UTIL}, {_RATIO}, {_FLAGS} FROM panel)"

#: Defects for the validation checks: unknown codes, nulls, values out of range.
_DIRT = {
    "EDUCATION": "CASE WHEN ID % 40 = 0 THEN 9 WHEN ID % 100 = 1 THEN 8 ELSE EDUCATION END",
    "AGE": "CASE WHEN ID % 50 = 0 THEN NULL WHEN ID % 70 = 0 THEN 7 WHEN ID % 90 = 0 THEN 130 ELSE AGE END",
    "PAY_STATUS_3": "CASE WHEN ID % 60 = 0 THEN 12 ELSE PAY_STATUS_3 END",
    "BILL_AMT2": "CASE WHEN ID % 80 = 0 THEN NULL ELSE BILL_AMT2 END",
}


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir)
    return df.select(*[F.expr(f"CAST({_DIRT[c]} AS BIGINT)").alias(c) if c in _DIRT else F.col(c) for c in df.columns])


DIRTY = f"{PANEL}, dirty AS (SELECT * REPLACE ({', '.join(f'CAST({e} AS BIGINT) AS {c}' for c, e in _DIRT.items())}) FROM panel)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, y, s, lang, source, toxic): labelled documents with a score that has ties."""
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    s = F.col("n_chars") / (F.col("n_chars") + 1500.0)
    return l.join(d.select("doc_id", "n_chars", "lang", "source"), "doc_id").select("doc_id", F.col("quality").cast("bigint").alias("y"), F.round(s, 3).alias("s"), "lang", "source", F.col("toxic").cast("bigint").alias("toxic"))


SCORED = """scored AS (SELECT l.doc_id, CAST(quality AS BIGINT) AS y, round(n_chars / (n_chars + 1500.0::DOUBLE), 3) AS s, lang, source, CAST(toxic AS BIGINT) AS toxic
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, ts, latency, error_type, expected_invalid, model, tokens_in, tokens_out, cached)."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.col("user_id"),
        F.col("value").alias("latency"),
        F.when(F.col("event_id") % 17 == 0, F.col("event_type")).alias("error_type"),
        (F.col("event_id") % 34 == 0).alias("expected_invalid"),
        F.concat(F.lit("model-"), (F.col("event_id") % 4).cast("string")).alias("model"),
        F.coalesce(k, F.lit(0)).alias("tokens_in"),
        (F.col("event_id") % 101).alias("tokens_out"),
        (F.col("event_id") % 13).alias("cached"),
    )


REQUESTS = """requests AS (SELECT event_id AS request_id, ts, user_id, value AS latency, CASE WHEN event_id % 17 = 0 THEN event_type END AS error_type,
  event_id % 34 = 0 AS expected_invalid, 'model-' || (event_id % 4) AS model, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS tokens_in,
  event_id % 101 AS tokens_out, event_id % 13 AS cached FROM events)"""


def query_set(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, passages) of the embeddings: each (id, document, v); every 20th is a query, all are passages."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("document"), F.col("embedding").alias("v"))
    return v.where("id % 20 = 0"), v


VECTORS = """unit AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS document, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings),
  hits AS (SELECT q.id AS query_id, q.document AS gold, p.id AS passage_id, p.document, round(list_dot_product(q.v, p.v), 9) AS score FROM unit q, unit p WHERE q.id % 20 = 0 AND p.id <> q.id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM hits)"""
