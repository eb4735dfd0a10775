"""Model fitting, cross-validation, calibration and attribution on ``pyspark.ml``.

Columns stay named doubles up to one assembler at the boundary.  Loops over folds, seeds and arms run
on the driver; every step inside is a distributed job.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import boosting as boosts
from . import metrics as M
from . import profiles as P
from . import resample as R
from .neighbours import nearest_rows
from .ranking import numbered

ROC_TOLERANCE, PR_TOLERANCE = 0.020, 0.015


class LeakageError(ValueError):
    """A fold's parameters or scores break their rule."""


def logistic(features: list[str], y: str = "y", weight: str | None = None, c: float = 1.0, n: int | None = None, iterations: int = 100) -> Pipeline:
    """L2 logistic regression; ``c`` is the inverse penalty of the summed loss, so regParam = 1 / (c n)."""
    lr = LogisticRegression(labelCol=y, regParam=1.0 / (c * n) if n else 0.0, elasticNetParam=0.0, maxIter=iterations, standardization=False)
    if weight:
        lr = lr.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error"), lr])


def forest(features: list[str], y: str = "y", trees: int = 300, depth: int = 10, leaf: int = 18, subset: str = "0.3", seed: int = R.SEED) -> Pipeline:
    rf = RandomForestClassifier(labelCol=y, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy=subset, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), rf])


def positive(model: PipelineModel, df: DataFrame, name: str = "s") -> DataFrame:
    """``df`` with the probability of class 1."""
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.select(*df.columns, name)


Factory = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def fitted(pipeline: Callable[[], Pipeline], score: str = "s") -> Factory:
    """A factory that fits a fresh pipeline on its training rows and returns a scoring function."""

    def fit(train: DataFrame):
        model = pipeline().fit(train)
        return lambda df: positive(model, df, score)

    return fit


def boosting(features: list[str], y: str = "y", settings: boosts.Settings | None = None, score: str = "s") -> Factory:
    """A factory of histogram boosting."""
    return lambda train: (lambda df: boosts.fit(train, features, y, settings).score(df, score))


def out_of_fold(df: DataFrame, fit: Factory, fold: str = "fold") -> DataFrame:
    """Every row scored once, by the model that didn't see it."""
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    parts = [fit(df.where(F.col(fold) != k))(df.where(F.col(fold) == k)) for k in folds]
    return reduce(DataFrame.unionByName, parts)


def cross_validated(df: DataFrame, fit: Factory, y: str = "y", s: str = "s", fold: str = "fold") -> DataFrame:
    """The metrics of each fold."""
    return M.all_metrics(out_of_fold(df, fit, fold), y, s, (fold,))


def permutation_check(df: DataFrame, fit: Factory, key: str, y: str = "y", seeds: tuple[int, ...] = (R.SEED,), folds: int = 5) -> DataFrame:
    """(seed, pr_auc, roc_auc, floor, deviations, within tolerance) after shuffling the labels."""
    rows = []
    for seed in seeds:  # each permutation ends in one row
        shuffled = written(R.stratified_folds(R.permuted(df, key, y, seed), key, y, folds, seed), "permuted")
        scored = written(out_of_fold(shuffled, fit).select(y, "s"), "scored")
        m = M.all_metrics(scored, y, "s").first()
        rows.append((seed, m["pr_auc"], m["roc_auc"], scored.agg(F.avg(F.col(y).cast("double"))).first()[0]))
    out = df.sparkSession.createDataFrame(rows, "seed bigint, pr_auc double, roc_auc double, floor double")
    dr, dp = F.abs(F.col("roc_auc") - 0.5), F.abs(F.col("pr_auc") - F.col("floor"))
    return out.withColumns({"roc_deviation": dr, "pr_deviation": dp, "clean": (dr <= ROC_TOLERANCE) & (dp <= PR_TOLERANCE)})


def null_distribution(checks: DataFrame) -> DataFrame:
    """Mean, offset, spread and worst deviation over permutations."""
    return checks.agg(
        F.count("*").alias("permutations"), F.avg("roc_auc").alias("roc_mean"), F.stddev_samp("roc_auc").alias("roc_std"), F.max("roc_deviation").alias("roc_worst"),
        F.avg("pr_auc").alias("pr_mean"), F.avg(F.col("pr_auc") - F.col("floor")).alias("pr_offset"), F.stddev_samp("pr_auc").alias("pr_std"), F.max("pr_deviation").alias("pr_worst"),
    )


def oversampled(df: DataFrame, key: str, y: str, columns: list[str], neighbours: int = 5, seed: int = R.SEED, block: int = 2000) -> DataFrame:
    """``df`` (key, y, columns) with synthetic positives until classes are even.  Runs jobs.

    The minority rows stand in seeded order; each gets its share of the missing rows, the first ones one more.  A synthetic
    row lies between its row and one of that row's exact nearest neighbours in the whole minority
    (ties to the earlier place), both drawn by hashes of seed, place and number: the result is the same
    at any ``block`` and in any engine.  Its key is negative.  Fewer than two positives, or enough of them: ``df`` as it is.
    """
    n, pos = df.agg(F.count("*"), F.count_if(F.col(y) == 1)).first()
    need = n - 2 * pos
    if pos < 2 or need <= 0:
        return df.select(key, y, *columns)
    minority = df.where(F.col(y) == 1).select(F.col(key).cast("bigint").alias(key), *[F.col(c).cast("double").alias(c) for c in columns])
    placed = written(numbered(minority, [R.draw(key, seed), F.col(key), *[F.col(c) for c in columns]], "__place"), "minority")
    near = nearest_rows(placed, "__place", columns, min(neighbours, pos - 1), block=block)
    k = min(neighbours, pos - 1)
    times = need // pos + F.when(F.col("__place") < need % pos, 1).otherwise(0)
    wanted = placed.select("__place", times.cast("int").alias("__times"), F.array(*columns).alias("__a")).where("__times > 0")
    wanted = wanted.select("__place", "__a", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)).alias("__i"))

    def drawn(name: str) -> Column:
        h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__place").cast("string"), F.col("__i").cast("string"), F.lit(name)).cast("binary"))
        return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")

    wanted = wanted.withColumns({"__rank": (drawn("row") % k + 1).cast("int"), "__u": drawn("part") / 2.0**32})
    chosen = wanted.join(near.select(F.col("key").alias("__place"), F.col("rank").alias("__rank"), F.col("other").alias("__other")), ["__place", "__rank"])
    made = chosen.join(placed.select(F.col("__place").alias("__other"), F.array(*columns).alias("__b")), "__other")
    values = [(F.col("__a")[j] + F.col("__u") * (F.col("__b")[j] - F.col("__a")[j])).alias(c) for j, c in enumerate(columns)]
    made = made.select((-1 - F.col("__place") - F.col("__i") * F.lit(pos)).cast(df.schema[key].dataType).alias(key), F.lit(1).cast(df.schema[y].dataType).alias(y), *values)
    return df.select(key, y, *columns).unionByName(made)


def sigmoid_map(scored: DataFrame, y: str = "y", s: str = "s") -> tuple[float, float]:
    """Platt's slope and intercept: regularised targets as weights of both labels.  Runs a fit."""
    pos, neg = scored.agg(F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)).first()
    hi, lo = (pos + 1) / (pos + 2), 1 / (neg + 2)
    target = F.when(F.col(y) == 1, hi).otherwise(lo)
    both = scored.select(F.col(s).alias("x"), F.explode(F.array(F.struct(F.lit(1.0).alias("l"), target.alias("w")), F.struct(F.lit(0.0).alias("l"), (1 - target).alias("w")))).alias("t")).select("x", "t.*")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LogisticRegression(labelCol="l", weightCol="w", regParam=0.0, maxIter=100)]).fit(both).stages[-1]
    return float(model.coefficients[0]), float(model.intercept)


def calibrated(scored: DataFrame, kind: str, y: str = "y", s: str = "s", name: str = "calibrated") -> DataFrame:
    """``scored`` with a calibrated probability: a map fitted on (out-of-fold) scores."""
    if kind == "sigmoid":
        a, b = sigmoid_map(scored, y, s)
        return scored.withColumn(name, 1 / (1 + F.exp(-(F.col(s) * a + b))))
    model = IsotonicRegression(labelCol="__y", featuresCol=s, predictionCol=name, isotonic=True).fit(scored.withColumn("__y", F.col(y).cast("double")))
    return model.transform(scored.withColumn("__y", F.col(y).cast("double"))).drop("__y")


def baseline_scores(df: DataFrame, key: str, y: str = "y") -> DataFrame:
    """``df`` with the scores of the two baselines: the base rate, and a seeded draw at that rate."""
    rate = df.agg(F.avg(F.col(y).cast("double")).alias("rate"))
    u = F.conv(F.substring(R.draw(key, 7), 1, 8), 16, 10).cast("double") / 2.0**32
    return df.crossJoin(F.broadcast(rate)).withColumn("stratified", (u < F.col("rate")).cast("double")).withColumnRenamed("rate", "trivial")


# -- attribution of a forest's score to features ---------------------------------------------------


def exported(model) -> list[dict[str, np.ndarray]]:
    """Node arrays of each tree: feature (-1 at a leaf), threshold, children, cover, P(class 1)."""
    out = []
    for tree in model.trees:
        nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "cover", "value")}

        def walk(node, nodes=nodes) -> int:
            i = len(nodes["feature"])
            for k in nodes:
                nodes[k].append(0)
            nodes["feature"][i] = -1
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                nodes["feature"][i], nodes["threshold"][i] = split.featureIndex(), split.threshold()
                nodes["left"][i] = walk(node.leftChild())
                nodes["right"][i] = walk(node.rightChild())
                nodes["cover"][i] = nodes["cover"][nodes["left"][i]] + nodes["cover"][nodes["right"][i]]
            else:
                counts = list(node.impurityStats().stats())
                nodes["cover"][i] = sum(counts)
                nodes["value"][i] = counts[1] / sum(counts) if sum(counts) else 0.0
            return i

        walk(tree._call_java("rootNode"))
        out.append({k: np.array(v) for k, v in nodes.items()})
    return out


def expected(tree: dict[str, np.ndarray], i: int = 0) -> float:
    if tree["feature"][i] < 0:
        return float(tree["value"][i])
    a, b = int(tree["left"][i]), int(tree["right"][i])
    return (expected(tree, a) * tree["cover"][a] + expected(tree, b) * tree["cover"][b]) / tree["cover"][i]


def paths(tree: dict[str, np.ndarray]) -> dict[int, tuple[np.ndarray, ...]]:
    """Leaves by the number m of features on their path: (features, low, high, zeros: each (leaves, m); value: (leaves)).

    A row goes to the leaf if low < x <= high for every feature; ``zeros`` is the share of the training rows
    that go on along the feature's splits.
    """
    found: dict[int, list] = {}
    stack = [(0, {})]
    while stack:
        i, path = stack.pop()
        f = int(tree["feature"][i])
        if f < 0:
            found.setdefault(len(path), []).append((path, float(tree["value"][i])))
            continue
        low, high, zero = path.get(f, (-np.inf, np.inf, 1.0))
        t = float(tree["threshold"][i])
        for child, bounds in ((int(tree["left"][i]), (low, min(high, t))), (int(tree["right"][i]), (max(low, t), high))):
            stack.append((child, {**path, f: (*bounds, zero * tree["cover"][child] / tree["cover"][i])}))
    out = {}
    for m, leaves in found.items():
        parts = [np.array([[p[f][j] for f in p] for p, _ in leaves]).reshape(len(leaves), m) for j in range(3)]
        out[m] = (np.array([list(p) for p, _ in leaves], dtype=np.int64).reshape(len(leaves), m), *parts, np.array([v for _, v in leaves]))
    return out


def shapley_rows(leaves: dict[int, tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """Shapley values of one tree's output for all rows of ``x`` at once, missing features following the training cover.

    The features on a leaf's path form a product game: feature k gets value * (one_k - zero_k) times the sum, over the
    number s of the others that are present, of the coefficient of t^s in prod(zero_j + one_j t), divided by m * C(m - 1, s).
    """
    phi = np.zeros(x.shape)
    for m, (features, low, high, zeros, value) in leaves.items():
        if not m:
            continue
        at = x[:, features]  # (rows, leaves, m)
        one = ((at > low) & (at <= high)).astype(float)
        weight = np.array([1.0 / (m * comb(m - 1, s)) for s in range(m)])
        for k in range(m):
            poly = np.ones((*one.shape[:2], 1))
            for j in range(m):
                if j != k:
                    longer = np.zeros((*one.shape[:2], poly.shape[2] + 1))
                    longer[..., :-1] = poly * zeros[:, j, None]
                    longer[..., 1:] += poly * one[..., j, None]
                    poly = longer
            part = (one[..., k] - zeros[:, k]) * (poly @ weight) * value
            for f in np.unique(features[:, k]):
                phi[:, f] += part[:, features[:, k] == f].sum(1)
    return phi


def shapley(tree: dict[str, np.ndarray], x: np.ndarray, features: int) -> np.ndarray:
    """Shapley values of one tree's output for one row."""
    return shapley_rows(paths(tree), np.asarray(x, dtype=float).reshape(1, features))[0]


#: Row-leaf pairs of a step: what is held at a time is that many times the longest path.
STEP = 1 << 18


def attribution(model: PipelineModel, df: DataFrame, key: str, features: list[str], top: int | None = None) -> DataFrame:
    """(key, feature, phi, direction, base, score, place): contributions to the forest's score.

    base plus all contributions of a row is the forest's score.  All rows of an Arrow batch go through a tree at once.
    """
    trees = exported(model.stages[-1])
    base = float(np.mean([expected(t) for t in trees]))
    shared = df.sparkSession.sparkContext.broadcast([paths(t) for t in trees])  # as large as the model
    most = max(sum(len(part[-1]) for part in leaves.values()) for leaves in shared.value)

    def run(parts):
        for pdf in parts:
            x = pdf[features].to_numpy(float)
            phi = np.zeros(x.shape)
            step = max(1, STEP // most)
            for lo in range(0, len(x), step):
                for leaves in shared.value:
                    phi[lo : lo + step] += shapley_rows(leaves, x[lo : lo + step])
            phi /= len(shared.value)
            many = len(features)
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), many), "feature": np.tile(np.array(features, dtype=object), len(x)), "phi": phi.ravel(), "base": base, "score": np.repeat(base + phi.sum(1), many)})

    out = df.select(F.col(key).cast("bigint").alias(key), *[F.col(f).cast("double").alias(f) for f in features]).mapInPandas(run, f"{key} bigint, feature string, phi double, base double, score double")
    from .trace import rank_in_group

    out = rank_in_group(out, key, [F.desc(F.abs("phi")), F.col("feature")]).withColumn("direction", F.when(F.col("phi") > 0, "raises").otherwise("lowers"))
    return out.where(F.col("place") <= top) if top else out


def attribution_rank(phi: DataFrame) -> DataFrame:
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"), F.avg("phi").alias("mean"))


def attribution_share(ranked: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, share): each group's part of the summed mean |phi|."""
    total = ranked.agg(F.sum("mean_abs").alias("total"))
    return ranked.join(groups, "feature").groupBy("group").agg(F.sum("mean_abs").alias("part")).crossJoin(F.broadcast(total)).select("group", F.col("part"), F.coalesce(F.try_divide("part", "total"), F.lit(0.0)).alias("share"))


def applicants(scores: DataFrame, p: str, threshold: float) -> DataFrame:
    """Decision rows of scored applicants."""
    from .panel import decision
    from .trace import band

    return scores.withColumn("decision", decision(F.col(p), threshold)).withColumn("band", band(F.col(p)))




def compare_arms(df: DataFrame, arms: dict[str, Factory], y: str = "y", fold: str = "fold") -> DataFrame:
    """(arm, fold, metric, value) of several models on one partition (``fold`` is in ``df`` already)."""
    names = [*M.MAXIMISE, "brier"]
    out = None
    for name, fit in arms.items():
        scored = written(out_of_fold(df, fit, fold).select(fold, y, "s"), f"arm-{name}")
        one = M.long_form(M.all_metrics(scored, y, "s", (fold,)), names, (fold,)).select(F.lit(name).alias("arm"), fold, "metric", "value")
        out = one if out is None else out.unionByName(one)
    return out


def blind(features: list[str], protected: list[str]) -> list[str]:
    """Features without those made of a protected column."""
    left = [f for f in features if not any(f == p or f.startswith(f"{p}_") for p in protected)]
    if not left:
        raise ValueError("no feature is left")
    return left


def constant(y: str = "y", score: str = "s") -> Factory:
    """A factory of the trivial model: every row gets the share of class 1 in the training rows."""

    def fit(train: DataFrame):
        rate = train.agg(F.avg(F.col(y).cast("double"))).first()[0]
        return lambda df: df.withColumn(score, F.lit(rate).cast("double"))

    return fit


def arm_table(folds: DataFrame, floor: str, metric: str = "pr_auc") -> DataFrame:
    """(arm, folds, mean, std, floor, lift, lift_in_stds) of ``compare_arms``: the distance from the arm called ``floor``.

    ``std`` is that of the sample of folds; a lift is null in stds where folds don't differ or there is one.
    """
    arms = folds.where(F.col("metric") == metric).groupBy("arm").agg(F.count("value").alias("folds"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    least = arms.where(F.col("arm") == floor).select(F.col("mean").alias("floor"))
    out = arms.where(F.col("arm") != floor).crossJoin(F.broadcast(least)).withColumn("lift", F.col("mean") - F.col("floor"))  # one row
    return out.withColumn("lift_in_stds", F.try_divide("lift", "std"))


def increments(arms: DataFrame, steps: dict[str, tuple[str, str]]) -> DataFrame:
    """(step, added, spread, in_stds, resolved): what arm ``more`` adds to arm ``less`` of each (less, more).

    A step is resolved if it is larger than the spread of ``less`` between folds.
    """
    pairs = arms.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in steps.items()], "step string, less string, more string")
    less, more = arms.select(F.col("arm").alias("less"), F.col("mean").alias("before"), F.col("std").alias("spread")), arms.select(F.col("arm").alias("more"), F.col("mean").alias("after"))
    out = pairs.join(less, "less").join(more, "more").withColumn("added", F.col("after") - F.col("before"))
    return out.select("step", "added", "spread", F.try_divide("added", "spread").alias("in_stds"), (F.abs("added") > F.col("spread")).alias("resolved"))


def blind_gaps(df: DataFrame, make: Callable[[list[str]], Factory], features: list[str], protected: dict[str, Column], threshold: float, y: str = "y", fold: str = "fold", least: int = P.MIN_GROUP) -> DataFrame:
    """(arm, attribute, groups, gaps, impact ratio) out of fold, with all features and without those of ``protected`` columns.

    Both arms share estimator and folds; ``protected`` maps each column to its groups.
    """
    out = None
    for arm, kept in (("all", features), ("blind", blind(features, list(protected)))):
        scored = out_of_fold(df, make(kept), fold)
        one = scored.select(F.lit(arm).alias("arm"), y, (F.col("s") >= threshold).alias("refused"), *[g.cast("string").alias(c) for c, g in protected.items()])
        out = one if out is None else out.unionByName(one)
    return P.attribute_gaps(written(out, "blind"), {c: F.col(c) for c in protected}, y, "refused", ("arm",), least)


def random_search(df: DataFrame, make: Callable[[dict], Factory], space: dict[str, list], trials: int, metric: str = "pr_auc", seed: int = R.SEED) -> DataFrame:
    """(trial, params, value): seeded draws from ``space``, each scored out of fold; the best first."""
    rng = np.random.default_rng(seed)
    rows = []
    for trial in range(trials):
        params = {k: v[int(rng.integers(len(v)))] for k, v in sorted(space.items())}
        scored = written(out_of_fold(df, make(params)).select("y", "s"), "trial")
        rows.append((trial, {k: str(v) for k, v in params.items()}, float(M.all_metrics(scored).first()[metric])))
    return df.sparkSession.createDataFrame(rows, "trial bigint, params map<string,string>, value double").orderBy(F.desc("value"), "trial")


def forest_of(model: PipelineModel):
    """The one forest of a fitted pipeline that scores two classes, or an error."""
    forests = [s for s in model.stages if hasattr(s, "trees")]
    if len(forests) != 1:
        raise ValueError(f"{len(forests)} forests in the pipeline")
    if forests[0].numClasses != 2:
        raise ValueError("the forest doesn't score two classes")
    return forests[0]


def check_names(model: PipelineModel, features: list[str]) -> None:
    """Raise unless the assembler reads exactly these features in this order."""
    read = [s.getInputCols() for s in model.stages if hasattr(s, "getInputCols") and s.hasParam("inputCols")]
    if read != [features]:
        raise ValueError(f"the model reads {read}, not {features}")


def round_trip(model: PipelineModel, df: DataFrame, key: str, path: str, tolerance: float = 1e-9) -> float:
    """Largest difference of scores after saving and loading; an error above the tolerance."""
    model.write().overwrite().save(path)
    again = positive(PipelineModel.load(path), df, "t")
    worst = positive(model, df).join(again.select(key, "t"), key).agg(F.max(F.abs(F.col("s") - F.col("t")))).first()[0] or 0.0
    if worst > tolerance:
        raise ValueError(f"scores differ by {worst}")
    return float(worst)
