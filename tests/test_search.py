import json

import numpy as np
import pytest
from lakeglean.operators import search as S
from pyspark.sql import functions as F

SPACE = {"a": S.Number(0.001, 10, log=True), "b": S.Number(2, 40, step=2), "c": S.Choice(("x", "y", "z"))}


def value(p):
    return -((np.log10(p["a"]) + 1) ** 2) - ((p["b"] - 30) / 10) ** 2 - (p["c"] != "y")


def run(startup, seed, n=60):
    done = []
    for t in range(n):
        p = S.propose(SPACE, done, np.random.default_rng([seed, t]), startup)
        assert 0.001 <= p["a"] <= 10 and p["b"] in range(2, 41, 2) and p["c"] in "xyz"
        done.append((p, value(p)))
    return [v for _, v in done]


def test_proposals_beat_random_draws():
    guided, blind = ([run(s, seed) for seed in range(12)] for s in (10, 1000))
    assert np.mean([max(v) for v in guided]) > np.mean([max(v) for v in blind])
    # what is tried late is good on the whole, not only at best
    assert np.mean([np.mean(v[30:]) for v in guided]) > np.mean([np.mean(v[30:]) for v in blind]) + 0.5
    assert run(10, 3) == run(10, 3)


def test_numbers_and_densities():
    n = S.Number(1, 80, step=1, log=True)
    rng = np.random.default_rng(0)
    draws = [n.random(rng) for _ in range(2000)]
    assert min(draws) == 1 and max(draws) == 80 and np.median(draws) < 15 and all(isinstance(d, int) for d in draws)
    assert S.Number(3, 10, step=4).outer(10) == 7
    centres, widths = S.Number(0, 10).density([2, 3])
    assert centres.tolist() == [2, 3, 5] and widths.tolist() == [2.5, 7, 10]
    assert S.Choice((1, 2)).propose([2] * 50, [1] * 50, rng) == 2


def test_nan_is_worst():
    trials = [({"a": 1.0, "b": 2, "c": "x"}, float("nan"))] * 20 + [({"a": 0.1, "b": 30, "c": "y"}, 1.0)] * 3
    got = [S.propose(SPACE, trials, np.random.default_rng(i))["c"] for i in range(30)]
    assert got.count("y") > 20


def test_nested_search_and_restart(spark, tmp_path):
    rows = [(i, int((i * 7919) % 100 < 30), (i * 37 % 101) / 101) for i in range(300)]
    df = spark.createDataFrame(rows, "k bigint, y bigint, x double")
    calls = []

    def make(params):
        def fit(train):
            calls.append((params["w"], train.count()))
            return lambda other: other.withColumn("s", F.col("y") * params["w"] + F.col("x") * (1 - params["w"]))

        return fit

    space = {"w": S.Number(0.0, 0.4)}
    path = f"file://{tmp_path}/trials"
    go = lambda p: [r.asDict() for r in S.nested_search(df, "k", "y", make, space, 4, p, outer=2, inner=2, startup=2).orderBy("fold").collect()]
    first = go(path)
    assert len(first) == 2 and [r["fold"] for r in first] == [1, 2]
    assert len(calls) == 2 * (4 * 2 + 1) and {n for _, n in calls} <= {74, 75, 76, 150}  # outer rows are never seen inside
    trials = S.TrialTable(spark, path)
    assert trials.read().count() == 8
    for r in first:
        assert r["inner_best"] == pytest.approx(max(v for _, v in trials.of(r["fold"])))
        assert json.loads(r["params"]) in [p for p, _ in trials.of(r["fold"])]
    # a restart only fits the chosen ones, a fresh run agrees, a table with a gap is filled
    calls.clear()
    assert go(path) == first and len(calls) == 2
    half = f"file://{tmp_path}/half"
    trials.read().where("outer_fold = 1 AND trial <> 2").write.parquet(half)
    calls.clear()
    assert go(half) == first and len(calls) == (2 * 2 + 1) + (4 * 2 + 1)
