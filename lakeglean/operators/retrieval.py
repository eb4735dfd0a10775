"""Exact vector retrieval and its evaluation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .neighbours import unit_rows

CUTOFFS = (1, 3, 5)
DEPTH = 10
#: Most bytes of query vectors that are broadcast; more queries go in blocks.
QUERY_BYTES = 64 << 20


class RetrievalError(ValueError):
    """A search names what the index doesn't hold."""


def known_documents(passages: DataFrame, documents: list[int]) -> DataFrame:
    """The passages of some documents; one without a passage is an error that lists known ones.  Runs one job."""
    found = passages.where(F.col("document").isin(documents))
    held = {r[0] for r in found.select("document").distinct().collect()}  # at most len(documents)
    if missing := sorted(set(documents) - held):
        known = [r[0] for r in passages.select("document").distinct().orderBy("document").limit(20).collect()]
        raise RetrievalError(f"no such documents: {missing}; there are {known}")
    return found


def by_ids(fragments: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    """A row for each asked id in any order: the fragment's columns, null where there is none, and ``found``."""
    asked = fragments.sparkSession.createDataFrame([(int(i),) for i in sorted(set(ids))], f"{key} bigint")
    held = fragments.where(F.col(key).isin(ids)).withColumn("found", F.lit(True))  # reaches the scan
    return asked.join(held, key, "left").na.fill(False, ["found"])


def build_index(chunks: DataFrame, path: str) -> None:
    """Write (id, document, shown, v) as the index at ``path``, in place of what is there.

    What is shown and the vector of what was embedded lie side by side.  Rows are sorted by ranges of (document, id), so a
    search within documents skips the row groups of others by their bounds; a document of any size is
    spread over files, and there is no folder a document.  No chunks is an error, and leaves the old index.
    """
    if chunks.isEmpty():
        raise RetrievalError("an index needs chunks")
    rows = chunks.select("id", "document", "shown", "v").repartitionByRange("document", "id")
    rows.sortWithinPartitions("document", "id").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id bigint, shown string, v array<float>, document bigint").parquet(path)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda m, x: m + x)


def unit(v: Column) -> Column:
    """The vector in double, of length 1."""
    return F.transform(v, lambda x: x.cast("double") / F.sqrt(dot(v, v)))


def top_k(queries: DataFrame, passages: DataFrame, k: int = DEPTH, documents: list[int] | None = None, dims: int = 64, others: bool = False) -> DataFrame:
    """(query_id, passage_id, document, score, rank) by cosine; ties go to the smaller id.

    With ``others`` a query doesn't find the passage of its own id.

    A stated query set against all passages: queries are broadcast in blocks of a checked size, every
    task multiplies them with its passages and keeps the k best of each query, and only those move.
    Vectors hold no nulls and are of one length.  Runs jobs.
    """
    if documents is not None:
        if not documents:
            raise ValueError("an empty filter finds nothing")
        passages = passages.where(F.col("document").isin(documents))
    q = queries.select(F.col("id").cast("bigint").alias("query_id"), unit_rows(queries, "v").alias("qv"))
    blocks = max(1, -(-queries.count() * dims * 8 // QUERY_BYTES))
    p = passages.select(F.col("id").cast("bigint").alias("passage_id"), F.col("document").cast("bigint").alias("document"), unit_rows(passages, "v").alias("pv"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "passage_id")
    out = None
    for b in range(blocks):
        part = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else q
        found = _best_of_task(p, part.toArrow(), k, others)
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        out = ranked if out is None else out.unionByName(ranked)
    return out


#: Query-passage products of a step.
PRODUCTS = 1 << 21


def _best_of_task(passages: DataFrame, asked, k: int, others: bool) -> DataFrame:
    """(query_id, passage_id, document, score): each task's ``k`` best passages of every query, by matrix products.

    ``asked`` is a table of at most ``QUERY_BYTES``; a task holds k candidates a query besides.
    """
    ids = asked.column("query_id").to_numpy()
    matrix = np.array(asked.column("qv").combine_chunks().flatten()).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
    shared = passages.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches):
        ids, matrix = shared.value
        at, pid, doc, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            step = max(1, PRODUCTS // len(ids))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                p_ids, docs = (part.column(c).to_numpy(zero_copy_only=False) for c in ("passage_id", "document"))
                s = np.round(matrix @ np.array(part.column("pv").flatten()).reshape(part.num_rows, -1).T, 9)
                if others:
                    s[ids[:, None] == p_ids[None, :]] = -np.inf
                if s.shape[1] > k:
                    bar = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    q, j = np.nonzero((s >= bar[:, None]) & np.isfinite(s))
                else:
                    q, j = np.nonzero(np.isfinite(s))
                at, pid, doc, score = (np.concatenate(x) for x in ((at, q), (pid, p_ids[j]), (doc, docs[j]), (score, s[q, j])))
                order = np.lexsort((pid, -score, at))
                at, pid, doc, score = at[order], pid[order], doc[order], score[order]
                keep = np.arange(len(at)) - np.searchsorted(at, at) < k
                at, pid, doc, score = at[keep], pid[keep], doc[keep], score[keep]
        yield pa.RecordBatch.from_arrays([pa.array(ids[at] if len(at) else at, pa.int64()), pa.array(pid), pa.array(doc), pa.array(score)], names=["query_id", "passage_id", "document", "score"])

    return passages.mapInArrow(run, "query_id bigint, passage_id bigint, document bigint, score double")


def first_rank(ranked: DataFrame, hit: Column) -> DataFrame:
    """(query_id, first_rank): rank of the first hit, 0 if there is none."""
    return ranked.groupBy("query_id").agg(F.coalesce(F.min(F.when(hit, F.col("rank"))), F.lit(0)).cast("bigint").alias("first_rank"))


def hit_rates(first: DataFrame) -> DataFrame:
    """One row: hit@k for each cut-off and the mean reciprocal rank, over the given queries."""
    r = F.col("first_rank")
    hits = [F.avg(((r >= 1) & (r <= k)).cast("double")).alias(f"hit_at_{k}") for k in CUTOFFS]
    return first.agg(F.count("*").alias("n"), *hits, F.avg(F.when(r > 0, 1.0 / r).otherwise(F.lit(0.0))).alias("mrr"))


def margins(ranked: DataFrame, depth: int = 5) -> DataFrame:
    """(query_id, margin): best score less the fifth, 0 with fewer."""
    at = {k: F.max(F.when(F.col("rank") == k, F.col("score"))) for k in (1, depth)}
    return ranked.groupBy("query_id").agg(F.coalesce(at[1] - at[depth], F.lit(0.0)).alias("margin"))


def homogenisation(vectors: DataFrame) -> DataFrame:
    """(same, pairs, mean): mean cosine of pairs within and across documents, in linear time.

    The sum of a . b over all pairs of a set is (|sum|^2 - sum |v|^2) / 2, so it takes one vector sum
    a document instead of a self join.
    """
    u = vectors.select("document", F.posexplode(unit(F.col("v"))).alias("i", "x"))
    sums = u.groupBy("document", "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    per = sums.groupBy("document").agg(((F.sum(F.col("s") * F.col("s")) - F.sum("q")) / 2).alias("within"))
    counts = vectors.groupBy("document").agg(F.count("*").alias("n"))
    total = sums.groupBy("i").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).agg(((F.sum(F.col("s") * F.col("s")) - F.sum("q")) / 2).alias("every"))
    inner = per.join(counts, "document").agg(F.sum("within").alias("w"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("wn"), F.sum("n").alias("n"))
    both = inner.crossJoin(F.broadcast(total))  # one row each
    n_all = F.col("n") * (F.col("n") - 1) / 2
    return both.select(F.explode(F.array(F.struct(F.lit(True).alias("same"), F.col("wn").cast("bigint").alias("pairs"), (F.col("w") / F.col("wn")).alias("mean")), F.struct(F.lit(False).alias("same"), (n_all - F.col("wn")).cast("bigint").alias("pairs"), ((F.col("every") - F.col("w")) / (n_all - F.col("wn"))).alias("mean")))).alias("r")).select("r.*")


def paired(first_a: DataFrame, first_b: DataFrame, k: int) -> DataFrame:
    """One row: queries that both, none, only the first or only the second strategy answers."""
    j = first_a.select("query_id", F.col("first_rank").between(1, k).alias("a")).join(first_b.select("query_id", F.col("first_rank").between(1, k).alias("b")), "query_id")
    a, b = F.col("a"), F.col("b")
    return j.agg(F.count_if(a & b).alias("both"), F.count_if(~a & ~b).alias("none"), F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"))


def common_failures(firsts: list[DataFrame], k: int) -> DataFrame:
    """(query_id) that no strategy answers."""
    every = None
    for f in firsts:
        part = f.select("query_id", F.col("first_rank").between(1, k).cast("int").alias("hit"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("query_id").agg(F.max("hit").alias("hit")).where("hit = 0").select("query_id")


def separability(tops: DataFrame) -> DataFrame:
    """One row from (answerable, score): how many answerable ones score no higher than the best of the others."""
    worst = tops.where("NOT answerable").agg(F.max("score").alias("bar"))
    return tops.where("answerable").crossJoin(F.broadcast(worst)).agg(F.count("*").alias("answerable"), F.count_if(F.col("score") <= F.col("bar")).alias("below"), F.max("bar").alias("bar"))


def unknown_gold(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """(question, gold) whose gold passage doesn't exist; must be empty for a sound set."""
    return questions.select("question", F.explode("gold").alias("gold")).join(passages.select(F.col("id").alias("gold")), "gold", "left_anti").select("question", "gold")
