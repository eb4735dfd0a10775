"""Toxic passages by maximum-scoring segment search, and a calibrated score of each document.

*Token weights.*  A word's features are the word itself and its prefixes of 3 to 6 letters (stems of
inflected words).  Counts of toxic and clean training documents give log-odds under an informative
Dirichlet prior, drawn from the pooled counts; a feature's weight is the lower confidence bound
``delta - z * sigma - offset`` where that is at least 0.5.  A word weighs as its best feature, every other word
``-drift``.

*Scan.*  Ruzzo and Tompa's linear-time scan gives all maximal scoring segments of a document, over
the whole text.

*Calibration.*  Under the background (posterior word probabilities of clean documents) the best
segment of n words follows an extreme-value law: the chance of a score of s is about
``K n exp(-lambda s)``.  ``lambda`` solves ``E exp(lambda s) = 1``; K is fitted to the maxima of
seeded background sequences.  A segment is significant if ``lambda s - log(K n) > 0``; these excesses
are summed, and a logistic curve over that sum, fitted on training documents, is the score.

The fit uses at most ``max_train`` labelled documents (the smallest hashes of their ids); their ids,
and at most ``max_features`` weights, are what is broadcast, and at most ``max_train`` distinct sums are what
the curve is fitted to.  Everything else covers all documents.

Defined cases: null and empty texts have no segment and get the score of a text without findings;
repeated rows are scored alike; without labels of both kinds every document scores 0.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"\w+")
MAX_TRAIN = 20_000
MAX_FEATURES = 50_000
THRESHOLD = 0.7
DRIFT = 0.25
OFFSET = 1.0
Z = 2.33
PRIOR_SHARE = 0.05
REPEATS = 3
LEAST_COUNT = 3
LEAST_WEIGHT = 0.5


@dataclass
class Model:
    """Feature weights, the extreme-value law of the background, and the logistic curve."""

    weights: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    intercept: float = -50.0
    slope: float = 0.0

    def excess(self, segments: list[tuple[int, int, float]], n: int) -> float:
        floor = np.log(max(1e-9, self.k * max(1, n)))
        return float(sum(max(0.0, self.lam * s - floor) for *_, s in segments))

    def score(self, excess: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.slope * np.log1p(excess), -50, 50))))


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in range(3, 7) if len(word) >= k)]


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past, score) of a sequence whose items weigh ``-drift``
    but for ``hits`` (position, positive weight), in linear time."""
    stack: list[tuple[int, int, float, float]] = []  # first, past, total before, total after
    total, at = 0.0, 0
    for pos, weight in hits:
        total -= drift * (pos - at)
        first, past, left, right = pos, pos + 1, total, total + weight
        total, at = right, pos + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, past, left, right))
    return [(a, b, right - left) for a, b, left, right in stack]


class Scanner:
    """Scores texts; remembers the weights of words it met, within a bound."""

    def __init__(self, model: Model, drift: float = DRIFT):
        self.model, self.drift, self.known = model, drift, {}

    def weight(self, word: str) -> float:
        weights = self.model.weights
        w = max((weights.get(f, 0.0) for f in features(word)), default=0.0)
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[word] = w
        return w

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = WORD.findall(text.lower()) if text else []
        known, weight = self.known, self.weight
        hits = [(i, w) for i, x in enumerate(words) if (w := known[x] if x in known else weight(x)) > 0]
        return len(words), maximal_segments(hits, self.drift) if hits else []

    def passages(self, text: str, segments: list[tuple[int, int, float]], n: int) -> list[dict]:
        """Significant segments with their character spans in the lower-cased text."""
        floor = np.log(max(1e-9, self.model.k * max(1, n)))
        spans = [m.span() for m in WORD.finditer(text.lower())] if segments else []
        return [{"start": spans[a][0], "end": spans[b - 1][1], "excess": float(self.model.lam * s - floor)} for a, b, s in segments if self.model.lam * s > floor]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _count(repeats: int | None):
    """(doc_id, text, toxic) to (feature, toxic count, clean count); the feature null counts all words."""

    def run(batches):
        yield from _counted(batches, repeats)

    return run


def _counted(batches, repeats: int | None):
    counts = {0: Counter(), 1: Counter()}
    total = [0, 0]

    def out():
        by = {None: total.copy()}
        total[:] = [0, 0]
        for y in (0, 1):
            for word, c in counts[y].items():
                for f in features(word):
                    by.setdefault(f, [0, 0])[y] += c
            counts[y].clear()
        names = list(by)
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([by[f][1] for f in part], pa.int64()), pa.array([by[f][0] for f in part], pa.int64())], names=["feature", "toxic", "clean"]
            )

    for batch in batches:
        for text, y in zip(batch.column("text"), batch.column("toxic"), strict=True):
            # a word that one document repeats says no more than one that it uses a few times
            words = Counter(WORD.findall((text.as_py() or "").lower()))
            words = {x: min(c, repeats or c) for x, c in words.items()}
            counts[y.as_py()].update(words)
            total[y.as_py()] += sum(words.values())
        if len(counts[0]) + len(counts[1]) > 500_000:
            yield from out()
    yield from out()


def _extreme_law(scores: np.ndarray, probs: np.ndarray, drift: float) -> tuple[float, float]:
    """lambda and K of a background of positive ``scores`` with ``probs``, else ``-drift``."""
    rest = max(1e-12, 1 - probs.sum())

    def excess(lam: float) -> float:
        return float((probs * np.exp(np.minimum(lam * scores, 700))).sum() + rest * np.exp(-lam * drift) - 1)

    lo, hi = 1e-6, 1.0
    while excess(hi) < 0 and hi < 60:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    lam = (lo + hi) / 2
    rng, n, best = np.random.Generator(np.random.PCG64(6)), 20_000, []
    share = probs / probs.sum()
    for _ in range(60):
        at = np.flatnonzero(rng.random(n) < probs.sum())
        weights = rng.choice(scores, len(at), p=share)
        best.append(max((s for *_, s in maximal_segments(list(zip(at.tolist(), weights.tolist(), strict=True)), drift)), default=0.0))
    k = float(np.exp(np.clip(lam * np.mean(best) - 0.5772, -20, 20)) / n)
    return lam, min(1.0, max(1e-6, k))


def _curve(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope of a ridge-penalised logistic curve (Newton steps) over rows that count ``times``."""
    design, beta, n = np.column_stack([np.ones(len(x)), x]), np.zeros(2), times.sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hess = design.T @ (design * (times * p * (1 - p))[:, None]) + ridge * n * np.diag([1e-3, 1.0]) / 10
        step = np.linalg.solve(hess + 1e-9 * np.eye(2), design.T @ (times * (y - p)) - ridge * n * np.array([1e-3, 1.0]) / 10 * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(0.0, beta[1]))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_features: int | None = MAX_FEATURES, least_count: int = LEAST_COUNT, repeats: int | None = REPEATS) -> Model:
    """Fit on the labelled documents that are not held out, at most ``max_train`` of them.

    ``max_features`` bounds the weights that are broadcast, those with the largest share of toxic words
    first; ``least_count`` is how often toxic documents must use a feature; ``repeats`` is how often one
    document's uses of a word count at most.  None, 1 and None turn these bounds off.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    train = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")
    counts = train.mapInArrow(_count(repeats), "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("y1"), F.sum("clean").alias("y0"))
    counts = counts.where(F.col("feature").isNull() | (F.col("y1") >= least_count) & (F.col("y1") * 4 > F.col("y0"))).orderBy(F.col("feature").isNotNull(), F.desc(F.col("y1") / (F.col("y0") + 1)), "feature")
    found = (counts if max_features is None else counts.limit(max_features + 1)).toArrow().to_pandas()
    total, found = found[found["feature"].isna()], found[found["feature"].notna()].set_index("feature")
    n1, n0 = float(total["y1"].sum()), float(total["y0"].sum())
    if not (n1 and n0 and len(found)):
        return Model()
    y1, y0 = found["y1"].to_numpy(float), found["y0"].to_numpy(float)
    a0 = PRIOR_SHARE * (n1 + n0)
    prior = PRIOR_SHARE * (y1 + y0)
    delta = np.log((y1 + prior) / (n1 + a0 - y1 - prior)) - np.log((y0 + prior) / (n0 + a0 - y0 - prior))
    sigma = np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
    weight = delta - Z * sigma - OFFSET
    good = weight > LEAST_WEIGHT
    if not good.any():
        return Model()
    model = Model(weights=dict(zip(found.index[good], weight[good].tolist(), strict=True)))
    # a word counts once although several of its features are known: whole words stand for the background
    whole = good & ~found.index.str.endswith("*")
    use = whole if whole.any() else good
    model.lam, model.k = _extreme_law(weight[use], (y0 + prior)[use] / (n0 + a0), DRIFT)
    # rows, not ids, are bounded: an id may have many
    rows = train.mapInArrow(_training_rows(model), "toxic int, excess double").groupBy("toxic", "excess").agg(F.count("*").alias("n"))
    rows = rows.orderBy(F.xxhash64("excess", "toxic"), "excess", "toxic").limit(max_train).toArrow().to_pandas()
    x, y = np.log1p(rows["excess"].to_numpy(float)), rows["toxic"].to_numpy(float)
    model.intercept, model.slope = _curve(x, y, rows["n"].to_numpy(float))
    return model


def _training_rows(model: Model):
    def run(batches):
        scanner = Scanner(model)
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([model.excess(s, n) for n, s in found])], names=["toxic", "excess"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, passages) of each row of ``docs`` (doc_id, text)."""

    def run(batches):
        scanner = Scanner(model)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("excess", pa.float64())]))
        for batch in batches:
            scores, passages = [], []
            for t in batch.column("text"):
                text = t.as_py() or ""
                n, segments = scanner.scan(text)
                scores.append(model.score(model.excess(segments, n)))
                passages.append(scanner.passages(text, segments, n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(passages, kind)],
                names=["doc_id", "score", "predicted", "passages"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int, passages array<struct<start: long, end: long, excess: double>>"
    )


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject."""

    def run(batches):
        scanner = Scanner(model)
        for batch in batches:
            keep = []
            for t in batch.column(batch.schema.get_field_index("text")):
                n, segments = scanner.scan(t.as_py())
                keep.append(model.score(model.excess(segments, n)) < THRESHOLD)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
