"""Quality classifier: document evidence combined with host and path posteriors (empirical Bayes).

*Document evidence.*  A logistic classifier over a few measures of the whole text (letters, marks,
case, repetition of words and lines, word lengths, ...), fitted on at most ``max_train`` labelled
documents.

*Sites.*  Every document's evidence and, where known, its label are summed by path and by host, over
all documents, in one grouped aggregation (partial sums, so a hot host is no hot task).  A host's
posterior shrinks its mean toward the global prior, a path's toward its host's, by
``strength / (strength + n)``; the strengths are estimated from the spread of the sites' means
(method of moments), so sites that don't differ more than chance count for nothing.  A document's own
label does not enter its own score: for it, its sites count its evidence in the label's place.

*Combination.*  The score is the document's log-odds plus those of its path's posterior over the
global prior.

Defined cases: null and empty texts have measures of zero and are scored; a null host or path is a site
of its own, apart from the empty one; repeated rows are scored alike and each counts for its site; without
labels of both kinds every document scores by the prior 0.5.  Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

MAX_TRAIN = 20_000
LABEL_WEIGHT = 1.0
MEASURES = 15
_WORDS = re.compile(r"\S+")


def measures(text: str | None) -> list[float]:
    """Measures of a whole text, each of order 1."""
    if not text:
        return [0.0] * MEASURES
    n = len(text)
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    upper = counts[65:91].sum()
    lower = counts[97:123].sum()
    digits = counts[48:58].sum()
    high = counts[128:].sum()
    space = counts[[9, 10, 13, 32]].sum()
    marks = size - upper - lower - digits - high - space
    common = counts[[44, 46]].sum()
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(m) / 5,
        np.log1p(n / m) / 2,
        float(marks / size) * 5,
        float((marks - common) / size) * 10,
        float(upper / max(1, upper + lower)),
        float(digits / size) * 10,
        distinct / m,
        pairs / m,
        len(set(lines)) / max(1, len(lines)),
        len(lines) / m * 5,
        float(counts[33] / size) * 20,
        float(counts[124] / size) * 20,
        float(counts[[35, 36, 37, 38, 42, 64]].sum() / size) * 20,
        float(counts[46] / m),
        max((len(w) for w in words), default=0) / 50,
    ]


def _expand(x: np.ndarray) -> np.ndarray:
    """Measures, their squares and a constant, capped so that no outlier rules."""
    x = np.clip(x, -10, 10)
    return np.column_stack([np.ones(len(x)), x, np.minimum(x * x, 25)])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, ridge: float = 1.0) -> np.ndarray | None:
    """Coefficients of the document classifier, or None without labels of both kinds."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    sample = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "quality")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([measures(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    got = rows.mapInArrow(run, "x array<double>, y int").orderBy("y", F.xxhash64("x")).limit(max_train).toArrow().to_pandas()
    if got["y"].nunique() < 2:
        return None
    x, y = _expand(np.stack(got["x"].to_numpy())), got["y"].to_numpy(float)
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.ones(x.shape[1])
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        beta += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def evidence(docs: DataFrame, beta: np.ndarray | None, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, logit) of each row of ``docs``."""

    def run(batches):
        for batch in batches:
            if beta is None or not batch.num_rows:
                logit = np.zeros(batch.num_rows)
            else:
                logit = np.clip(_expand(np.array([measures(t) for t in batch.column(3).to_pylist()])) @ beta, -12, 12)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(logit)], names=["doc_id", "host", "path", "logit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, host string, path string, logit double")


def _strength(n, mean, prior: str):
    """Pseudo-documents of a level's prior, by the method of moments over its sites' means.

    Within-site variance is Bernoulli's at the prior; what the means spread beyond it is the
    variance between sites.
    """
    within = F.col(prior) * (1 - F.col(prior))
    between = (F.sum(n * F.pow(mean - F.col(prior), 2)) - F.sum(within)) / F.greatest(F.sum(n) - F.sum(n * n) / F.sum(n), F.lit(1e-9))
    return F.least(F.lit(1e9), F.avg(within) / F.greatest(between, F.lit(1e-9)))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``evidence`` rows with ``p``, what a document's evidence says, and ``value``: its label, if known, or p."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("quality").alias("quality"))
    p = 1 / (1 + F.exp(-F.col("logit")))
    rows = docs.join(known, F.col("doc_id") == F.col("l_id"), "left").withColumn("p", p)
    value = F.when(F.col("quality").isNotNull(), (1 - LABEL_WEIGHT) * F.col("p") + LABEL_WEIGHT * F.col("quality")).otherwise(F.col("p"))
    return rows.select("doc_id", "host", "path", "logit", "p", value.alias("value"))


def sites(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, path, n, s, hn, hs, prior, h_strength, p_strength) of each path, from ``judged`` rows."""
    paths = scratch.cut(rows.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("s")), "paths")
    hosts = scratch.cut(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")), "hosts")
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    prior = ((total["s"] or 0.0) + 1) / ((total["n"] or 0.0) + 2)
    hosts = hosts.withColumn("prior", F.lit(prior))
    h_strength = hosts.agg(_strength(F.col("hn"), F.col("hs") / F.col("hn"), "prior")).first()[0] or 1e9
    paths = paths.withColumnRenamed("host", "p_host").join(hosts, F.col("p_host").eqNullSafe(F.col("host"))).drop("p_host").withColumn("h_strength", F.lit(h_strength))
    paths = paths.withColumn("host_mean", _shrunk("hn", "hs", "h_strength", F.col("prior")))
    p_strength = paths.agg(_strength(F.col("n"), F.col("s") / F.col("n"), "host_mean")).first()[0] or 1e9
    return scratch.cut(paths.drop("host_mean").withColumn("p_strength", F.lit(p_strength)), "sites")


def _shrunk(n: str, s: Column | str, strength: str, prior: Column) -> Column:
    s = F.col(s) if isinstance(s, str) else s
    return (s + F.col(strength) * prior) / (F.col(n) + F.col(strength))


def classified(docs: DataFrame, labels: DataFrame, host: Column, path: Column, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, host, path, document, host_posterior, path_posterior, score, predicted)."""
    scratch = Scratch(docs.sparkSession, "quality")
    beta = fit(docs, labels, max_train)
    rows = scratch.cut(judged(evidence(docs, beta, host, path), labels), "judged")

    def logit(p: Column) -> Column:
        q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
        return F.log(q / (1 - q))

    known = sites(rows, scratch).withColumnsRenamed({"host": "s_host", "path": "s_path"})
    out = rows.join(known, rows["host"].eqNullSafe(known["s_host"]) & rows["path"].eqNullSafe(known["s_path"]))
    own = F.col("value") - F.col("p")  # what the own label adds to the sums
    out = out.withColumn("host_posterior", _shrunk("hn", F.col("hs") - own, "h_strength", F.col("prior")))
    out = out.withColumn("path_posterior", _shrunk("n", F.col("s") - own, "p_strength", F.col("host_posterior")))
    score = 1 / (1 + F.exp(-(F.col("logit") + logit(F.col("path_posterior")) - logit(F.col("prior")))))
    return out.select("doc_id", "host", "path", F.col("p").alias("document"), "host_posterior", "path_posterior", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source`` is the host and ``lang`` the path below it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classified(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"), F.concat("source", F.lit("/"), "lang"))
