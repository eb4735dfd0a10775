import random

import numpy as np
from pyspark.sql import functions as F

from lakeglean.operators import profiles as P
from lakeglean.operators.ranking import numbered, running


def test_numbers_follow_the_order(spark):
    rng = random.Random(2)
    values = [rng.randrange(50) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "k bigint, v bigint").repartition(6)
    got = numbered(df, [F.col("v").desc(), F.col("k").asc()], "i").orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(300))
    assert [r["k"] for r in got] == [k for k, v in sorted(enumerate(values), key=lambda x: (-x[1], x[0]))]


def test_running_sums_match_plain_ones(spark):
    rng = random.Random(3)
    rows = [(float(v), rng.randrange(10)) for v in rng.sample(range(100_000), 400)]
    got = {r["v"]: r["s"] for r in running(spark.createDataFrame(rows, "v double, n bigint"), "v", {"s": "n"}).collect()}
    total = 0
    for v, n in sorted(rows):
        total += n
        assert got[v] == total
    assert running(spark.createDataFrame([], "v double, n bigint"), "v", {"s": "n"}).count() == 0


def test_ranks_by_ranges_equal_ranks_by_window(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.randrange(30)) for i in range(200)] + [(900, None)], "k bigint, v bigint")
    a = {r["k"]: r["r"] for r in P.average_ranks(df, "v", "r").collect()}
    assert a == {r["k"]: r["r"] for r in P.average_ranks(df, "v", "r", many=True).collect()} and a[900] is None


def test_quantiles_match_numpy(spark):
    from lakeglean.operators.ranking import quantiles

    rng = np.random.default_rng(3)
    groups = [None if i % 5 == 0 else i % 3 for i in range(400)]
    rows = [(g, float(x) if i % 7 else None, float(y)) for i, (g, x, y) in enumerate(zip(groups, rng.normal(size=400), rng.integers(0, 4, 400), strict=True))]
    df = spark.createDataFrame([*rows, (9, None, 1.0)], "g int, x double, y double")
    at = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = quantiles(df, {"x": F.col("x"), "y": F.col("y")}, at).first()
    for k, name in ((1, "x"), (2, "y")):
        known = [r[k] for r in [*rows, (9, None, 1.0)] if r[k] is not None]
        assert np.allclose(got[name], np.quantile(known, at), atol=1e-12)
    by = {r["g"]: r for r in quantiles(df, {"x": F.col("x"), "y": F.col("y")}, at, ("g",)).collect()}
    assert set(by) == {None, 0, 1, 2, 9} and by[9]["x"] is None
    for g in (None, 0, 1, 2):
        assert np.allclose(by[g]["x"], np.quantile([r[1] for r in rows if r[0] == g and r[1] is not None], at), atol=1e-12)
    empty = quantiles(df.limit(0), {"x": F.col("x")}, at).collect()
    assert len(empty) == 1 and empty[0]["x"] is None


def test_quantiles_hold_where_bounds_miss_them(spark, monkeypatch):
    from lakeglean.operators import ranking

    rng = np.random.default_rng(5)
    values = rng.normal(size=3000)
    df = spark.createDataFrame([(i % 2, float(x) if i % 9 else None, float(i % 4 > 0)) for i, x in enumerate(values)], "g int, x double, y double").repartition(7)
    at = [0.0, 0.1, 0.5, 0.93, 1.0]
    held = [r["x"] for r in df.collect() if r["x"] is not None]
    calls = []
    plain = ranking._ends_by_ranges
    monkeypatch.setattr(ranking, "_ends_by_ranges", lambda *a: calls.append(1) or plain(*a))
    for accuracy, margin, missed in ((10_000, 4, 0), (20, 4, 0), (20, -1, 1)):
        monkeypatch.setattr(ranking, "ACCURACY", accuracy)
        monkeypatch.setattr(ranking, "MARGIN", margin)
        got = ranking.quantiles(df, {"x": F.col("x"), "y": F.col("y")}, at).first()
        assert np.allclose(got["x"], np.quantile(held, at), atol=1e-12) and got["y"][0] == 0.0 and got["y"][2] == 1.0
        by = {r["g"]: r["x"] for r in ranking.quantiles(df, {"x": F.col("x")}, at, ("g",)).collect()}
        for g in (0, 1):
            assert np.allclose(by[g], np.quantile([r["x"] for r in df.collect() if r["g"] == g and r["x"] is not None], at), atol=1e-12)
        assert bool(calls) == bool(missed)


def test_approximate_bounds_are_not_made_twice(spark):
    """A second run of a sketch may give other bounds, so none may stand in a plan that reads its ranges in two places."""
    from lakeglean.operators.ranking import quantiles

    df = spark.range(1000).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    for out in (quantiles(df, {"v": F.col("v")}, [0.5]), running(df, "v", {"s": "n"})):
        assert "percentile_approx" not in out._jdf.queryExecution().toString()
