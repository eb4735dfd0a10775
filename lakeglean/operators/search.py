"""Parameter search by a tree-structured Parzen estimator, nested in outer folds.

Trials are split into the few good ones and the rest; for each parameter two densities are made of them, and of
some draws from the good one that with the largest ratio of the two is tried next.  Every trial is a
distributed cross-validation over inner folds and one row of a table in the shared folder, so a search that ends
early goes on where it stood.  Draws depend on seed, outer fold and trial only: reruns and
restarts agree.  The rows of an outer fold are never seen by the search whose choice they score.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from . import metrics as M
from . import resample as R
from .models import Factory, cross_validated

STARTUP, CANDIDATES = 10, 24
TRIAL = "outer_fold int, trial int, params string, value double"


@dataclass(frozen=True)
class Number:
    """A number in [low, high]; whole multiples of ``step`` above low, if given; drawn by its logarithm, if ``log``."""

    low: float
    high: float
    step: int | None = None
    log: bool = False

    def inner(self, x: float) -> float:
        return math.log(x) if self.log else float(x)

    def outer(self, z: float) -> float | int:
        x = float(min(max(math.exp(z) if self.log else z, self.low), self.high))
        if not self.step:
            return x
        return int(min(self.low + round((x - self.low) / self.step) * self.step, self.low + (self.high - self.low) // self.step * self.step))

    def random(self, rng: np.random.Generator) -> float | int:
        return self.outer(rng.uniform(self.inner(self.low), self.inner(self.high)))

    def density(self, seen: list) -> tuple[np.ndarray, np.ndarray]:
        """Centres and widths of normal parts: one a trial, as wide as the farther neighbour is away, and one over the whole range."""
        lo, hi = self.inner(self.low), self.inner(self.high)
        z = np.sort(np.array([self.inner(x) for x in seen], dtype=float))
        ends = np.concatenate([[lo], z, [hi]])
        widths = np.maximum(ends[1:-1] - ends[:-2], ends[2:] - ends[1:-1])
        whole = max(hi - lo, 1e-12)
        widths = np.clip(widths, whole / min(100.0, len(z) + 2.0), whole)
        return np.concatenate([z, [(lo + hi) / 2]]), np.concatenate([widths, [whole]])

    def propose(self, good: list, bad: list, rng: np.random.Generator):
        centres, widths = self.density(good)
        at = rng.integers(0, len(centres), CANDIDATES)
        draws = np.clip(rng.normal(centres[at], widths[at]), self.inner(self.low), self.inner(self.high))
        values = [self.outer(z) for z in draws]
        z = np.array([self.inner(v) for v in values])

        def log_density(parts):
            c, w = parts
            e = -0.5 * ((z[:, None] - c) / w) ** 2 - np.log(w)
            return np.log(np.exp(e - e.max(1, keepdims=True)).mean(1)) + e.max(1)

        return values[int((log_density((centres, widths)) - log_density(self.density(bad))).argmax())]


@dataclass(frozen=True)
class Choice:
    options: tuple

    def random(self, rng: np.random.Generator):
        return self.options[int(rng.integers(len(self.options)))]

    def propose(self, good: list, bad: list, rng: np.random.Generator):
        share = lambda seen: np.array([seen.count(o) + 1.0 / len(self.options) for o in self.options]) / (len(seen) + 1.0)
        g = share(good)
        draws = rng.choice(len(self.options), CANDIDATES, p=g)
        return self.options[int(draws[(g / share(bad))[draws].argmax()])]


Space = dict[str, Number | Choice]


def propose(space: Space, trials: list[tuple[dict, float]], rng: np.random.Generator, startup: int = STARTUP) -> dict:
    """The next parameters after ``trials`` of (parameters, value); larger values are better, NaN is worst."""
    if len(trials) < startup:
        return {k: s.random(rng) for k, s in sorted(space.items())}
    ranked = sorted(trials, key=lambda t: -math.inf if math.isnan(t[1]) else t[1], reverse=True)
    n = min(math.ceil(0.1 * len(ranked)), 25)
    good, bad = [p for p, _ in ranked[:n]], [p for p, _ in ranked[n:]]
    return {k: s.propose([p[k] for p in good], [p[k] for p in bad], rng) for k, s in sorted(space.items())}


class TrialTable:
    """Trials at ``path``, appended one at a time; the first of two rows of one number counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(TRIAL).parquet(self.path)
        except AnalysisException as e:  # no folder yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], TRIAL)

    def of(self, fold: int) -> list[tuple[dict, float]]:
        """Trials of an outer fold in order, up to the first gap."""
        rows = {r["trial"]: r for r in self.read().where(F.col("outer_fold") == fold).collect()}  # one row a trial
        out = []
        while len(out) in rows:
            out.append((json.loads(rows[len(out)]["params"]), rows[len(out)]["value"]))
        return out

    def add(self, fold: int, trial: int, params: dict, value: float) -> None:
        self.spark.createDataFrame([(fold, trial, json.dumps(params, sort_keys=True), float(value))], TRIAL).coalesce(1).write.mode("append").parquet(self.path)


def search(train: DataFrame, key: str, y: str, make: Callable[[dict], Factory], space: Space, trials: int, table: TrialTable, fold: int = 0, inner: int = 3, metric: str = "pr_auc", startup: int = STARTUP, seed: int = R.SEED) -> tuple[dict, float]:
    """The best (parameters, mean of the inner folds) of ``trials`` trials on ``train``; those in ``table`` aren't run again."""
    done = table.of(fold)
    if len(done) < trials:
        dealt = written(R.stratified_folds(train, key, y, inner, seed + fold), "inner")
        for t in range(len(done), trials):
            params = propose(space, done, np.random.default_rng([seed, fold, t]), startup)
            value = cross_validated(dealt, make(params), y).agg(F.avg(metric)).first()[0]
            value = math.nan if value is None else float(value)
            table.add(fold, t, params, value)
            done.append((params, value))
    return max(done[:trials], key=lambda t: -math.inf if math.isnan(t[1]) else t[1])


def nested_search(df: DataFrame, key: str, y: str, make: Callable[[dict], Factory], space: Space, trials: int, path: str, outer: int = 5, inner: int = 3, metric: str = "pr_auc", startup: int = STARTUP, seed: int = R.SEED) -> DataFrame:
    """(fold, params, inner_best, metrics of the fold's rows by the model fitted on all others with those parameters)."""
    table = TrialTable(df.sparkSession, path)
    dealt = written(R.stratified_folds(df, key, y, outer, seed), "outer")
    out = None
    for k in range(1, outer + 1):
        train = dealt.where(F.col("fold") != k).drop("fold")
        params, best = search(train, key, y, make, space, trials, table, k, inner, metric, startup, seed)
        scored = written(make(params)(train)(dealt.where(F.col("fold") == k)).select("fold", y, "s"), "outer-scores")
        one = M.all_metrics(scored, y, "s", ("fold",)).withColumns({"params": F.lit(json.dumps(params, sort_keys=True)), "inner_best": F.lit(best)})
        out = one if out is None else out.unionByName(one)
    return out
