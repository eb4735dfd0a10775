"""Queries of vector retrieval and its evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import neighbours as N
from ..operators import retrieval as R
from ..operators.ranking import quantiles
from ..sources.shared import shared_dir
from . import views as V
from .profiles import rounded
from .registry import query


def ranked(spark, d, k: int = 10, documents=None):
    q, p = V.query_set(spark, d)
    gold = q.select(F.col("id").alias("query_id"), F.col("document").alias("gold"))
    return R.top_k(q, p, k, documents, others=True).join(gold, "query_id")


_TOP = f"WITH {V.VECTORS}, top AS (SELECT * FROM ranked WHERE rank <= 10)"
_FIRST = f"{_TOP}, first AS (SELECT query_id, CAST(coalesce(min(CASE WHEN document = gold THEN rank END), 0) AS BIGINT) AS first_rank FROM top GROUP BY query_id)"
_SECOND = "second AS (SELECT query_id, CAST(coalesce(min(CASE WHEN passage_id % 3 = 0 THEN rank END), 0) AS BIGINT) AS first_rank FROM top GROUP BY query_id)"


def firsts(spark, d):
    return R.first_rank(ranked(spark, d), F.col("document") == F.col("gold"))


def seconds(spark, d):
    return R.first_rank(ranked(spark, d), F.col("passage_id") % 3 == 0)


@query("vector_topk", f"{_TOP} SELECT query_id, passage_id, document, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, gold FROM top")
def vector_topk(spark, d):
    return rounded(ranked(spark, d))


def inverted(spark, d):
    """An index of all passages, built in the shared folder, and the query set."""
    q, p = V.query_set(spark, d)
    chunks = p.withColumn("shown", F.concat(F.lit("chunk "), F.col("id").cast("string")))
    return N.build_inverted_file(chunks, f"{shared_dir(spark)}/inverted-{uuid.uuid4().hex[:12]}"), q


@query("ivf_topk", None)
def ivf_topk(spark, d):
    index, q = inverted(spark, d)
    return rounded(index.search(q, 10, others=True))


@query("ivf_exact", f"{_TOP} SELECT query_id, passage_id, document, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top")
def ivf_exact(spark, d):
    """The same index with every cell visited."""
    index, q = inverted(spark, d)
    return rounded(index.search(q, 10, exact=True, others=True))


@query("ivf_recall", None)
def ivf_recall(spark, d):
    """One row: the share of the exact neighbours that the index finds, and the share of query-row pairs that it compares."""
    index, q = inverted(spark, d)
    truth = R.top_k(q, V.query_set(spark, d)[1], 10, others=True).select("query_id", "passage_id")
    found = index.search(q, 10, others=True).select("query_id", "passage_id", F.lit(1).alias("hit"))
    recall = truth.join(found, ["query_id", "passage_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall_at_10"))
    return rounded(recall.crossJoin(F.broadcast(index.scanned_share(q))))  # one row each


@query(
    "vector_topk_filtered",
    f"WITH {V.VECTORS}, f AS (SELECT query_id, passage_id, document, score, gold, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM hits WHERE document IN (1, 4)) SELECT query_id, passage_id, document, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, gold FROM f WHERE rank <= 5",
)
def vector_topk_filtered(spark, d):
    return rounded(ranked(spark, d, 5, [1, 4]))


@query("fragment_lookup", "SELECT i.item_id, text, text IS NOT NULL AS found FROM (SELECT unnest([1, 5, 9, -4])::BIGINT AS item_id) i LEFT JOIN benchmark b ON b.item_id = i.item_id")
def fragment_lookup(spark, d):
    return R.by_ids(V.table(spark, d, "benchmark").select("item_id", "text"), [9, 1, -4, 5, 5], "item_id").select("item_id", "text", "found")


@query("first_rank", f"{_FIRST} SELECT * FROM first")
def first_rank(spark, d):
    return firsts(spark, d)


_HITS = ", ".join(f"round(avg(CAST(first_rank BETWEEN 1 AND {k} AS DOUBLE)), 6) AS hit_at_{k}" for k in (1, 3, 5))


@query("hit_at_k", f"{_FIRST} SELECT count(*) AS n, {_HITS} FROM first")
def hit_at_k(spark, d):
    return rounded(R.hit_rates(firsts(spark, d)).drop("mrr"))


@query("mrr", f"{_FIRST} SELECT round(avg(CASE WHEN first_rank > 0 THEN 1.0::DOUBLE / first_rank ELSE 0 END), 6) AS mrr FROM first")
def mrr(spark, d):
    return rounded(R.hit_rates(firsts(spark, d)).select("mrr"))


@query("score_margin", f"{_TOP} SELECT query_id, round(coalesce(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 5 THEN score END), 0), 6) AS margin FROM top GROUP BY query_id")
def score_margin(spark, d):
    return rounded(R.margins(ranked(spark, d)))


@query(
    "homogenisation",
    f"WITH {V.VECTORS} SELECT a.document = b.document AS same, count(*) AS pairs, round(avg(list_dot_product(a.v, b.v)), 6) AS mean FROM unit a JOIN unit b ON a.id < b.id GROUP BY 1",
)
def homogenisation(spark, d):
    v = V.table(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("document"), F.col("embedding").alias("v"))
    return rounded(R.homogenisation(v))


@query(
    "paired_strategies",
    f"{_FIRST}, {_SECOND}, j AS (SELECT f.first_rank BETWEEN 1 AND 3 AS a, s.first_rank BETWEEN 1 AND 3 AS b FROM first f JOIN second s ON f.query_id = s.query_id) SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (NOT a AND NOT b) AS none, count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (NOT a AND b) AS only_second FROM j",
)
def paired_strategies(spark, d):
    return R.paired(firsts(spark, d), seconds(spark, d), 3)


@query("common_failures", f"{_FIRST}, {_SECOND} SELECT f.query_id FROM first f JOIN second s ON f.query_id = s.query_id WHERE NOT f.first_rank BETWEEN 1 AND 1 AND NOT s.first_rank BETWEEN 1 AND 1")
def common_failures(spark, d):
    return R.common_failures([firsts(spark, d), seconds(spark, d)], 1)


@query(
    "threshold_separability",
    f"{_TOP}, t AS (SELECT query_id, gold % 3 <> 0 AS answerable, max(score) AS score FROM top GROUP BY 1, 2), w AS (SELECT max(score) AS bar FROM t WHERE NOT answerable) SELECT count(*) AS answerable, count(*) FILTER (score <= bar) AS below, round(max(bar), 6) AS bar FROM t, w WHERE answerable",
)
def threshold_separability(spark, d):
    tops = ranked(spark, d).where("rank = 1").select("query_id", (F.col("gold") % 3 != 0).alias("answerable"), "score")
    return rounded(R.separability(tops))


@query("annotation_antijoin", "SELECT CAST(vec_id AS BIGINT) AS question, CAST(vec_id * 2 AS BIGINT) AS gold FROM embeddings e WHERE vec_id % 20 = 0 AND NOT EXISTS (SELECT 1 FROM embeddings p WHERE p.vec_id = e.vec_id * 2)")
def annotation_antijoin(spark, d):
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"))
    q = e.where("id % 20 = 0").select(F.col("id").alias("question"), F.array(F.col("id"), F.col("id") * 2).alias("gold"))
    return R.unknown_gold(q, e)


@query(
    "overlap_by_document",
    """WITH o AS (SELECT lang, source, CAST(n_chars AS DOUBLE) AS x FROM documents) SELECT source, round(avg(x), 6) AS mean, round(median(x), 6) AS p50, max(x) AS greatest, count(*) AS n FROM o GROUP BY source""",
)
def overlap_by_document(spark, d):
    """Mean, median, maximum and number of a measure by gold document (here: lengths by source)."""
    g = V.table(spark, d, "documents").select("source", F.col("n_chars").cast("double").alias("x"))
    p50 = quantiles(g, {"q": F.col("x")}, [0.5], ("source",)).select(F.col("source").alias("s"), F.col("q")[0].alias("p50"))
    out = g.groupBy("source").agg(F.avg("x").alias("mean"), F.max("x").alias("greatest"), F.count("*").alias("n"))
    return rounded(out.join(p50, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "mean", "p50", "greatest", "n"))


@query(
    "rank_matrix",
    f"{_FIRST}, {_SECOND} SELECT f.query_id, f.first_rank AS by_label, s.first_rank AS by_third FROM first f JOIN second s ON f.query_id = s.query_id WHERE f.query_id % 100 = 0",
)
def rank_matrix(spark, d):
    both = firsts(spark, d).withColumn("strategy", F.lit("by_label")).unionByName(seconds(spark, d).withColumn("strategy", F.lit("by_third")))
    tagged = both.withColumn("tags", F.when(F.col("query_id") % 100 == 0, F.array(F.lit("numeric"))).otherwise(F.array().cast("array<string>")))
    return tagged.where(F.array_contains("tags", "numeric")).groupBy("query_id").pivot("strategy", ["by_label", "by_third"]).agg(F.first("first_rank"))
