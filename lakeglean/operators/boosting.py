"""Histogram gradient boosting of two classes, with trees grown leaf by leaf, best split first.

Features are binned once, at quantiles of their values; a row is a few bytes, its label, weight and margin.
A pass over the rows gives sums of gradients and curvatures by (node, feature, bin): each task adds up its own
in arrays of a fixed size, one grouped aggregation adds those of the tasks, and a task a node finds its best
split in a histogram of fixed size, so the driver sees one row a node.

The order of splits is that of growing one leaf at a time by the largest gain.  A pass is not made for
each split, though: it also looks at the children of the other leaves that may still be split,
so a tree takes about as many passes as it is deep.  Margins are written every ``CUT`` rounds; between
them the tasks add the few newest trees themselves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: The bin of unknown values; so many bins at most for known ones.
MISSING, MOST_BINS = 255, 255
#: Rounds between tables of margins.
CUT = 10


@dataclass(frozen=True)
class Settings:
    rounds: int = 300
    rate: float = 0.05
    leaves: int = 31
    least_rows: int = 20
    least_curvature: float = 1e-3
    l2: float = 0.0
    bins: int = MOST_BINS
    balanced: bool = False


@dataclass
class Tree:
    """Node arrays; a node without children (left 0) is a leaf."""

    feature: list[int] = field(default_factory=lambda: [0])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, i: int, best: dict) -> None:
        self.feature[i], self.bin[i], self.missing_left[i] = best["feature"], best["bin"], best["missing_left"]
        for side in (self.left, self.right):
            side[i] = len(self.left)
            for a, v in ((self.feature, 0), (self.bin, 0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.value, 0.0)):
                a.append(v)

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``bins`` (rows, features)."""
        feature, at_most, missing_left, left, right = (np.array(x) for x in (self.feature, self.bin, self.missing_left, self.left, self.right))
        node = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(left[node] > 0)
            if not len(inner):
                return node
            n = node[inner]
            b = bins[inner, feature[n]]
            node[inner] = np.where(np.where(b == MISSING, missing_left[n], b <= at_most[n]), left[n], right[n])

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


@dataclass
class Model:
    features: list[str]
    edges: list[np.ndarray]
    start: float
    trees: list[Tree]

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.stack([binned(x, e) for x, e in zip(columns, self.edges, strict=True)], axis=1)

    def score(self, df: DataFrame, name: str = "s") -> DataFrame:
        """``df`` with the probability of class 1."""
        shared = df.sparkSession.sparkContext.broadcast(self)  # as large as the model

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            model = shared.value
            for part in parts:
                bins = model.binned([part[f"f{i}"].to_numpy(float) for i in range(len(model.features))])
                margin = model.start + sum((t.values(bins) for t in model.trees), np.zeros(len(bins)))
                yield pd.Series(1.0 / (1.0 + np.exp(-margin)))

        probability = F.pandas_udf(run, "double")
        return df.withColumn(name, probability(F.struct(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(self.features)])))


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin b holds edges[b - 1] < x <= edges[b]; the last one what is above; unknown values have their own."""
    return np.where(np.isnan(x), MISSING, np.searchsorted(edges, x)).astype(np.uint8)


def quantile_edges(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Upper ends of the bins of each feature, its greatest value left out: one pass."""
    inner = [i / bins for i in range(1, bins + 1)]
    row = df.agg(*[F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None)), inner, F.lit(10_000)).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.array(row[f"q{i}"] or [0.0], dtype=float))[:-1][: MOST_BINS - 1] for i in range(len(features))]


def histograms(rows: DataFrame, newest: list[Tree], tree: Tree, nodes: list[int], features: int) -> DataFrame:
    """(slot, feature, bin, g, h, n) of the rows in each of ``nodes``, which are leaves of ``tree``."""
    shared = rows.sparkSession.sparkContext.broadcast((newest, tree, nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        newest, tree, nodes = shared.value
        slot_of = np.full(len(tree.left), -1)
        slot_of[nodes] = np.arange(len(nodes))
        sums = np.zeros((3, len(nodes) * features * 256))
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, features)
            y, w, margin = (batch.column(c).to_numpy() for c in ("y", "w", "margin"))
            margin = margin + sum((t.values(bins) for t in newest), np.zeros(len(bins)))
            p = 1.0 / (1.0 + np.exp(-margin))
            slot = slot_of[tree.leaf_of(bins)]
            here = slot >= 0
            at = ((slot[here, None] * features + np.arange(features)) * 256 + bins[here]).ravel()
            for k, x in enumerate((w * (p - y), w * p * (1 - p), np.ones(len(y)))):
                sums[k] += np.bincount(at, np.repeat(x[here], features), sums.shape[1])
        found = np.flatnonzero(sums[2])
        columns = [found // (features * 256), found // 256 % features, found % 256]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in columns] + [pa.array(s[found]) for s in sums], names=["slot", "feature", "bin", "g", "h", "n"])

    parts = rows.select("bins", "y", "w", "margin").mapInArrow(run, "slot int, feature int, bin int, g double, h double, n double")
    return parts.groupBy("slot", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])


SPLIT = "slot int, gain double, feature int, bin int, missing_left boolean, gl double, hl double, nl double, gr double, hr double, nr double"


def best_splits(sums: DataFrame, s: Settings) -> DataFrame:
    """``SPLIT`` of each slot that has one; of equal gains (nine places) the first feature and bin, unknown values to the right."""

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        found = None
        for feature, part in pdf.groupby("feature"):  # 256 rows each at most
            h = np.zeros((3, 256))
            h[:, part["bin"]] = part[["g", "h", "n"]].to_numpy().T
            every, unknown = h.sum(1), h[:, MISSING]
            upto = h[:, :MISSING].cumsum(1)
            held = np.flatnonzero(h[2, :MISSING])
            for missing_left in (False, True) if unknown[2] else (False,):
                left = upto[:, held] + (unknown[:, None] if missing_left else 0.0)
                right = every[:, None] - left
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.round(left[0] ** 2 / (left[1] + s.l2) + right[0] ** 2 / (right[1] + s.l2) - every[0] ** 2 / (every[1] + s.l2), 9)
                fair = (np.minimum(left[2], right[2]) >= s.least_rows) & (np.minimum(left[1], right[1]) >= s.least_curvature)
                gain = np.where(fair, gain, 0.0)
                i = int(gain.argmax()) if len(gain) else 0
                if len(gain) and gain[i] > 0 and (found is None or (-gain[i], feature, held[i]) < found[:3]):
                    found = (-gain[i], feature, held[i], missing_left, *left[:, i], *right[:, i])
        names = [f.split()[0] for f in SPLIT.split(", ")]
        return pd.DataFrame([] if found is None else [(pdf["slot"].iloc[0], -found[0], *found[1:])], columns=names)

    return sums.groupBy("slot").applyInPandas(best, SPLIT)


def grow(rows: DataFrame, newest: list[Tree], features: int, s: Settings) -> Tree:
    """A tree of at most ``leaves`` leaves whose leaf values are the steps of the margin."""
    seen = Tree()  # the nodes looked at; the tree is a part of it
    best: dict[int, dict | None] = {}
    todo = [0]
    while True:
        found = {r["slot"]: r.asDict() for r in best_splits(histograms(rows, newest, seen, todo, features), s).collect()}  # a row a node
        best |= {n: found.get(i) for i, n in enumerate(todo)}
        # grow one leaf at a time, as far as all that compete are known
        heap = [(-best[0]["gain"], 0)] if best[0] else []
        splits, todo = [], []
        while heap and len(splits) < s.leaves - 1:
            _, i = heapq.heappop(heap)
            splits.append(i)
            if not seen.left[i]:
                seen.split(i, best[i])
            children = (seen.left[i], seen.right[i])
            todo = [c for c in children if c not in best]
            if todo:
                break
            for c in children:
                if best[c]:
                    heapq.heappush(heap, (-best[c]["gain"], c))
        if not todo or len(splits) == s.leaves - 1:
            break
        for _, i in heapq.nsmallest(s.leaves - 1 - len(splits), heap):  # their turn may come
            if not seen.left[i]:
                seen.split(i, best[i])
            todo += [c for c in (seen.left[i], seen.right[i]) if c not in best]
    tree, at = Tree(), {0: 0}
    for i in splits:
        k = at[i]
        tree.split(k, best[i])
        for side, child in (("l", seen.left[i]), ("r", seen.right[i])):
            at[child] = tree.left[k] if side == "l" else tree.right[k]
            tree.value[at[child]] = -s.rate * best[i][f"g{side}"] / (best[i][f"h{side}"] + s.l2)
    return tree


def fit(df: DataFrame, features: list[str], y: str = "y", settings: Settings | None = None) -> Model:
    """A model of ``df`` (features, y of 0 or 1).  Rows of one class only, or none, are an error.  Runs jobs."""
    s = settings or Settings()
    if not 2 <= s.bins <= MOST_BINS:
        raise ValueError(f"{s.bins} bins")
    n, pos = df.agg(F.count("*"), F.count_if(F.col(y) == 1)).first()
    if not 0 < pos < n:
        raise ValueError("boosting needs rows of both classes")
    weight = F.when(F.col(y) == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))) if s.balanced else F.lit(1.0)
    share = 0.5 if s.balanced else pos / n
    model = Model(features, quantile_edges(df, features, s.bins), float(np.log(share / (1 - share))), [])
    shared = df.sparkSession.sparkContext.broadcast(model.edges)
    many = len(features)

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.stack([binned(batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float), shared.value[i]) for i in range(many)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bins], pa.binary()), *[batch.column(many + i) for i in range(3)]], names=["bins", "y", "w", "margin"])

    narrow = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col(y).cast("double").alias("y"), weight.alias("w"), F.lit(model.start).alias("margin"))
    rows = written(narrow.mapInArrow(bytes_of, "bins binary, y double, w double, margin double"), "binned")
    newest: list[Tree] = []
    for _ in range(s.rounds):
        tree = grow(rows, newest, many, s)
        if not tree.left[0]:  # nothing left to split
            break
        model.trees.append(tree)
        newest.append(tree)
        if len(newest) == CUT:
            rows, newest = written(moved(rows, newest, many), "margins"), []
    return model


def moved(rows: DataFrame, trees: list[Tree], features: int) -> DataFrame:
    """``rows`` with the steps of ``trees`` added to their margins."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, features)
            margin = batch.column("margin").to_numpy() + sum((t.values(bins) for t in shared.value), np.zeros(len(bins)))
            yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("y"), batch.column("w"), pa.array(margin)], names=["bins", "y", "w", "margin"])

    return rows.mapInArrow(run, "bins binary, y double, w double, margin double")
