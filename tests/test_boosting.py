import numpy as np
import pandas as pd
import pytest
from lakeglean.operators import boosting as B
from lakeglean.operators import models as L


def table(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 1] = rng.integers(0, 4, n)
    x[rng.random(n) < 0.15, 2] = np.nan
    x[:, 3] = 1.0
    margin = 2 * (x[:, 0] > 0.3) - 1.5 * (x[:, 1] == 2) + np.where(np.isnan(x[:, 2]), 1.5, -x[:, 2]) - 0.5
    y = (rng.random(n) < 1 / (1 + np.exp(-margin))).astype(int)
    df = pd.DataFrame(x, columns=list("abcd"))
    df["y"] = y
    return df, spark.createDataFrame(df).repartition(3)


def plain(bins, y, w, margin, s):
    """The steps of one tree, grown one leaf at a time by looking at every split of every leaf."""
    p = 1 / (1 + np.exp(-margin))
    g, h = w * (p - y), w * p * (1 - p)
    part = lambda i: g[i].sum() ** 2 / (h[i].sum() + s.l2)

    def best(rows):
        found = None
        for f in range(bins.shape[1]):
            for b in np.unique(bins[rows, f]):
                if b == B.MISSING:
                    continue
                for missing_left in (False, True):
                    known = bins[rows, f] != B.MISSING
                    if missing_left and known.all():
                        continue
                    go = np.where(known, bins[rows, f] <= b, missing_left)
                    left, right = rows[go], rows[~go]
                    if min(len(left), len(right)) < s.least_rows or min(h[left].sum(), h[right].sum()) < s.least_curvature:
                        continue
                    key = (-round(part(left) + part(right) - part(rows), 9), f, b, missing_left)
                    if key[0] < 0 and (found is None or key < found[0]):
                        found = (key, left, right)
        return found

    leaves = [np.arange(len(y))]
    while len(leaves) < s.leaves:
        splits = [(best(r), i) for i, r in enumerate(leaves)]
        splits = [(x[0][0], i, x) for x, i in splits if x]
        if not splits:
            break
        _, i, (_, left, right) = min(splits, key=lambda t: t[:2])
        leaves[i : i + 1] = [left, right]
    step = np.zeros(len(y))
    if len(leaves) > 1:
        for rows in leaves:
            step[rows] = -s.rate * g[rows].sum() / (h[rows].sum() + s.l2)
    return step


@pytest.mark.parametrize(("balanced", "cut"), [(False, 1), (True, 10)])
def test_against_a_plain_version(spark, monkeypatch, balanced, cut):
    monkeypatch.setattr(B, "CUT", cut)
    local, df = table(spark)
    s = B.Settings(rounds=2, rate=0.3, leaves=9, least_rows=10, bins=12, balanced=balanced, l2=0.5)
    model = B.fit(df, list("abcd"), settings=s)
    bins = model.binned([local[c].to_numpy() for c in "abcd"])
    y = local["y"].to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balanced else np.ones(len(y))
    margin = np.full(len(y), model.start)
    for tree in model.trees:
        step = plain(bins, y, w, margin, s)
        assert tree.values(bins) == pytest.approx(step, abs=1e-9)
        margin = margin + step
    assert len(model.trees) == 2 and sum(x == 0 for x in model.trees[0].left) == 9
    got = model.score(df).toPandas()
    expected = dict(zip(map(repr, local[list("abcd")].to_numpy().tolist()), 1 / (1 + np.exp(-margin)), strict=True))
    assert got["s"].to_numpy() == pytest.approx([expected[repr(r)] for r in got[list("abcd")].to_numpy().tolist()], abs=1e-9)


def test_held_out_rows_and_refusals(spark):
    local, df = table(spark, 1500)
    _, other = table(spark, 700, seed=9)
    s = B.Settings(rounds=5, rate=0.4, least_rows=20, bins=32)
    scored = L.boosting(list("abcd"), settings=s)(df)(other).toPandas()
    rate = local["y"].mean()
    assert ((scored["s"] - scored["y"]) ** 2).mean() < 0.8 * ((rate - scored["y"]) ** 2).mean()
    with pytest.raises(ValueError, match="both classes"):
        B.fit(df.where("y = 1"), ["a"])
    with pytest.raises(ValueError, match="bins"):
        B.fit(df, ["a"], settings=B.Settings(bins=256))
    constant = B.fit(df, ["d"], settings=s)
    assert constant.trees == [] and constant.score(df).select("s").distinct().count() == 1
