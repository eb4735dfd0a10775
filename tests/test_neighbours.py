import numpy as np
import pandas as pd
import pytest
from lakeglean.operators import models as L
from lakeglean.operators import neighbours as N
from lakeglean.operators import retrieval as RT
from pyspark.sql import functions as F


def table(spark, x):
    return spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(x.shape[1])]).reset_index(names="k"))


def brute(x, k):
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :k]
    return order, np.take_along_axis(d, order, 1)


def points():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(150, 3)) + c for c in ([0, 0, 0], [6, 6, 6], [9, 0, 3])])
    # a third of all rows is one point, others lie on a grid: many ties
    return np.concatenate([x, np.tile([1.0, 2.0, 3.0], (300, 1)), np.round(x[:120]), [[-0.0, 0, 0], [0.0, 0, 0]]])


@pytest.mark.parametrize("block", [50, 2048])
@pytest.mark.parametrize("pivots", [1, None])
def test_nearest_rows_are_exact(spark, block, pivots):
    x = points()
    got = N.nearest_rows(table(spark, x), "k", ["c0", "c1", "c2"], 5, pivots=pivots, block=block).toPandas().sort_values(["key", "rank"])
    order, distance = brute(x, 5)
    assert (got["other"].to_numpy().reshape(-1, 5) == order).all() and (got["rank"].to_numpy().reshape(-1, 5) == np.arange(1, 6)).all()
    assert got["distance"].to_numpy().reshape(-1, 5) == pytest.approx(distance, abs=1e-8)


def test_nearest_rows_of_few_and_bad_rows(spark):
    two = N.nearest_rows(table(spark, np.array([[0.0], [2.0]])), "k", ["c0"], 5).collect()
    assert sorted(map(tuple, two)) == [(0, 1, 2.0, 1), (1, 0, 2.0, 1)]
    assert N.nearest_rows(table(spark, np.zeros((1, 1))), "k", ["c0"], 5).count() == 0
    assert N.nearest_rows(table(spark, np.zeros((1, 1))).where("k > 5"), "k", ["c0"], 5).count() == 0
    with pytest.raises(ValueError, match="null or NaN"):
        N.nearest_rows(table(spark, np.array([[1.0], [np.nan]])), "k", ["c0"], 1)


def test_oversampling_draws_exact_neighbours_at_any_block_size(spark):
    x = points()[:500]
    minority = table(spark, x).withColumn("y", F.lit(1))
    df = minority.unionByName(spark.range(1300).select((F.col("id") + 10_000).alias("k"), *[F.lit(0.0).alias(c) for c in ("c0", "c1", "c2")], F.lit(0).alias("y")))
    runs = [L.oversampled(df, "k", "y", ["c0", "c1", "c2"], block=b).where("k < 0").orderBy("k").toPandas() for b in (60, 2000)]
    assert len(runs[0]) == 800 and runs[0].equals(runs[1]) and runs[0]["k"].is_unique
    # each synthetic row lies on a segment from a row to one of its five nearest
    made = runs[0][["c0", "c1", "c2"]].to_numpy()
    near, _ = brute(x, 5)
    a, b = np.repeat(x, 5, axis=0), x[near.ravel()]
    length = np.sqrt(((a - b) ** 2).sum(1))
    for m in made:
        through = np.sqrt(((a - m) ** 2).sum(1)) + np.sqrt(((b - m) ** 2).sum(1)) - length
        assert through.min() < 1e-6


def clustered(spark, n=3000, dims=16):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, dims))[rng.integers(0, 40, n)] + 0.25 * rng.normal(size=(n, dims))
    v[: n // 3] = v[0]  # a third of all rows are copies
    return spark.createDataFrame([(i, int(i % 7), f"s{i}", x.tolist()) for i, x in enumerate(v)], "id long, document long, shown string, v array<double>")


def test_inverted_file(spark, tmp_path):
    rows = clustered(spark)
    path = f"file://{tmp_path}/index"
    index = N.build_inverted_file(rows, path)
    asked = rows.where("id % 20 = 0")
    truth = RT.top_k(asked, rows, 10, dims=16, others=True)
    expected = {tuple(r) for r in truth.select("query_id", "passage_id", "document", "score", "rank").collect()}
    assert {tuple(r) for r in index.search(asked, 10, exact=True, others=True).collect()} == expected
    found = index.search(asked, 10, others=True)
    assert found.join(truth, ["query_id", "passage_id"]).count() >= 0.95 * len(expected)
    share = index.scanned_share(asked).first()
    assert share["queries"] == 150 and share["share"] < 0.5  # a third of all rows is one cell
    again = N.VectorIndex(spark, path)
    assert (again.n, again.cells, again.probes, again.dims) == (3000, index.cells, index.probes, 16)
    within = again.search(asked, 5, exact=True, documents=[3, 4], others=True)
    assert {tuple(r) for r in within.collect()} == {tuple(r) for r in RT.top_k(asked, rows, 5, [3, 4], 16, True).select(*within.columns).collect()}
    with pytest.raises(ValueError, match="chunks"):
        N.build_inverted_file(rows.limit(0), path)
    with pytest.raises(ValueError, match="filter"):
        index.search(asked, 5, documents=[])
    assert N.VectorIndex(spark, path).n == 3000


def test_an_index_of_one_row(spark, tmp_path):
    rows = clustered(spark).where("id = 5")
    index = N.build_inverted_file(rows, f"file://{tmp_path}/one")
    assert [r["passage_id"] for r in index.search(rows, 3).collect()] == [5] and index.search(rows, 3, others=True).count() == 0


def test_products_in_small_steps(spark, monkeypatch):
    rows = clustered(spark, 400)
    whole = RT.top_k(rows, rows, 4, dims=16).collect()
    monkeypatch.setattr(RT, "PRODUCTS", 900)
    assert sorted(RT.top_k(rows, rows, 4, dims=16).collect()) == sorted(whole) and len(whole) == 1600


def test_distances_to_pivots_are_held_in_slices(spark, monkeypatch):
    from lakeglean.operators import neighbours as N

    monkeypatch.setattr(N, "DISTANCES", 64)
    assert [s.stop - s.start for s in N.slices(20, 9)] == [7, 7, 6] and [s.stop for s in N.slices(2, 100)] == [1, 2]
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "k bigint, a double, b double")
    got = {(r["key"], r["rank"]): r["other"] for r in N.nearest_rows(df, "k", ["a", "b"], 3, pivots=9).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert got == {(i, j + 1): int(o) for i in range(60) for j, o in enumerate(np.argsort(d[i], kind="stable")[:3])}
