"""Nearest neighbours by cells: an inverted file for vector search, and exact joins of each row with its nearest.

Both cut the space into cells around pivots.  Rows of a cell and the queries that visit it meet in
blocks of bounded size (matrix products on Arrow data), so a cell with a third of all rows is many
tasks, not one.  Each block keeps the ``k`` best of a query, and only those move on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

#: Rows and queries of a block; most cells of an index; rows a cell that the pivots are fitted on.
BLOCK, MOST_CELLS, FIT_ROWS = 2048, 4096, 64
#: Most bytes of pivots that are broadcast.
PIVOT_BYTES = 64 << 20
#: Most distances to pivots that a task holds at once.
DISTANCES = 1 << 20


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def fit_pivots(vectors: DataFrame, v: str, cells: int, seed: int = 42) -> np.ndarray:
    """At most ``cells`` k-means centres, fitted on at most about ``FIT_ROWS`` rows a cell.  Runs jobs."""
    n = vectors.count()
    share = min(1.0, FIT_ROWS * cells / max(n, 1))
    some = vectors.select(array_to_vector(doubles(F.col(v))).alias("features"))
    if share < 1:
        some = some.sample(False, share, seed)
    model = KMeans(k=max(2, min(cells, n)), maxIter=10, seed=seed, initSteps=1).fit(written(some, "fit"))
    centres = np.array(model.clusterCenters())
    if centres.nbytes > PIVOT_BYTES:
        raise ValueError(f"{len(centres)} pivots of {centres.shape[1]} dimensions are more than {PIVOT_BYTES} bytes")
    return centres


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0)


def slices(n: int, pivots: int) -> Iterator[slice]:
    """Slices of ``n`` rows whose distances to all pivots are at most ``DISTANCES``, or one row."""
    step = max(1, DISTANCES // max(1, pivots))
    return (slice(i, min(i + step, n)) for i in range(0, n, step))


def in_cells(df: DataFrame, v: str, pivots: np.ndarray, visits: int = 1) -> DataFrame:
    """``df`` once for each of the ``visits`` nearest pivots, with ``cell``, ``order`` (0: the nearest) and ``reach`` (the distance)."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)
    visits = min(visits, len(pivots))

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            if not len(part):
                yield pd.Series([], dtype=object)
                continue
            found = []
            for s in slices(len(part), len(shared.value)):
                d = squared(np.stack(part.iloc[s].to_numpy()), shared.value)
                near = np.argsort(d, axis=1, kind="stable")[:, :visits]
                found += [[(int(c), float(math.sqrt(d[i, c]))) for c in row] for i, row in enumerate(near)]
            yield pd.Series(found)

    nearest = F.pandas_udf(run, "array<struct<cell:int,reach:double>>")
    found = df.select("*", F.posexplode(nearest(doubles(F.col(v)))).alias("order", "__at"))
    return found.select(*df.columns, "order", F.col("__at.cell").alias("cell"), F.col("__at.reach").alias("reach"))


def met(queries: DataFrame, rows: DataFrame, k: int, cosine: bool, others: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best rows of the cells that a query visits, ties to the smaller id.

    ``queries`` (query_id, cell, qv) may stand in several cells, ``rows`` (id, cell, v) in one.  The
    score is the cosine of unit vectors, or the distance.  With ``others`` no query finds its own id.
    """

    def parted(df: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
        sizes = df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(f"{name}s"))  # a row a cell
        return sizes, df.join(F.broadcast(sizes), "cell").withColumn(name, F.pmod(F.xxhash64(key), F.col(f"{name}s").cast("long")).cast("int")).drop(f"{name}s")

    q_sizes, q = parted(queries.select("query_id", "cell", "qv"), "query_id", "q_part")
    r_sizes, r = parted(rows.select("id", "cell", "v"), "id", "r_part")
    # each part of one side goes to every part of the other side of its cell
    q = q.join(F.broadcast(r_sizes), "cell").withColumn("r_part", F.explode(F.sequence(F.lit(0), F.col("r_parts") - 1))).drop("r_parts")
    r = r.join(F.broadcast(q_sizes), "cell").withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1))).drop("q_parts")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        if not len(a) or not len(b):
            return out
        ids, asked = b["id"].to_numpy(), a["query_id"].to_numpy()
        x, y = np.stack(a["qv"].to_numpy()), np.stack(b["v"].to_numpy())
        # distances of what is close come from differences, so that equal rows are at distance 0
        d = np.round(-(x @ y.T), 9) if cosine else squared(x, y)
        if others:
            d[asked[:, None] == ids[None, :]] = np.inf
        if d.shape[1] > k:
            bar = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
            at, to = np.nonzero((d <= bar + (0 if cosine else 1e-9 * (1 + bar))) & np.isfinite(d))
        else:
            at, to = np.nonzero(np.isfinite(d))
        score = d[at, to] if cosine else np.round(np.sqrt(((x[at] - y[to]) ** 2).sum(1)), 9)
        order = np.lexsort((ids[to], score, at))
        at, to, score = at[order], to[order], score[order]
        first = np.searchsorted(at, np.arange(len(x)))
        keep = np.arange(len(at)) - first[at] < k
        return pd.DataFrame({"query_id": asked[at[keep]], "id": ids[to[keep]], "score": -score[keep] if cosine else score[keep]})

    keys = ["cell", "q_part", "r_part"]
    q, r = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (q, r))  # both may come from one table
    found = q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(best, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if cosine else F.asc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# -- exact k nearest neighbours --------------------------------------------------------------------


def nearest_rows(points: DataFrame, key: str, columns: list[str], k: int, pivots: int | None = None, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """(key, other, distance, rank): the exact ``k`` nearest other rows of every row, ties to the smaller key.

    Distances are rounded to nine places before they are compared.

    Equal rows are one point with its ``k + 1`` smallest keys, so a group of copies of any size costs
    as much as one row.  Each point meets the points of its own cell first; the distance to the k-th of them bounds the
    search.  Then it visits only cells that can hold something nearer: by the triangle inequality no row of a cell
    is nearer than the distance to the pivot less the cell's radius, or than the plane half-way between the pivots.
    Keys are distinct longs; rows with a null among ``columns`` are an error.  Runs jobs.
    """
    values = points.select(F.col(key).cast("long").alias("key"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    # -0.0 and 0.0 are one value
    values = values.select("key", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).alias("v"))
    if not values.where(F.exists("v", lambda x: x.isNull() | F.isnan(x))).isEmpty():
        raise ValueError(f"a null or NaN in {columns}")
    first = Window.partitionBy("v").orderBy("key")
    few = values.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)  # pruned before the shuffle
    distinct = written(few.groupBy("v").agg(F.min("key").alias("id"), F.sort_array(F.collect_list("key")).alias("keys")), "points")
    n = distinct.count()
    schema = "key long, other long, distance double, rank int"
    if n == 0:
        return points.sparkSession.createDataFrame([], schema)
    cells = min(MOST_CELLS, pivots or max(1, int(math.sqrt(n))))
    centres = fit_pivots(distinct, "v", cells, seed) if cells > 1 and n > 1 else np.zeros((1, len(columns)))
    placed = written(in_cells(distinct.select("id", "v"), "v", centres), "placed")
    own = written(met(placed.select(F.col("id").alias("query_id"), "cell", F.col("v").alias("qv")), placed, k + 1, False, block=block), "own")
    # k + 1 points, itself among them, hold at least k other rows
    bound = own.where(F.col("rank") == k + 1).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    radius = {r[0]: r[1] for r in placed.groupBy("cell").agg(F.max("reach")).collect()}  # a row a cell
    reach = np.array([radius.get(i, -np.inf) for i in range(len(centres))])
    between = np.sqrt(squared(centres, centres))
    shared = points.sparkSession.sparkContext.broadcast((centres, reach, between))

    def visits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, reach, between = shared.value
        for part in (whole.iloc[s] for whole in parts for s in slices(len(whole), len(centres))):
            x, cell = np.stack(part["v"].to_numpy()), part["cell"].to_numpy()
            bound = part["bound"].fillna(np.inf).to_numpy()
            d = np.sqrt(squared(x, centres))
            own = d[np.arange(len(x)), cell]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(between[cell] > 0, (d * d - (own * own)[:, None]) / (2 * between[cell]), 0.0)
            least = np.maximum(d - reach[None, :], plane)
            # a margin for rounding; it can only add visits
            go = (least <= bound[:, None] * (1 + 1e-9) + 1e-6) & np.isfinite(reach)[None, :]
            go[np.arange(len(x)), cell] = False
            at, to = np.nonzero(go)
            yield pd.DataFrame({"query_id": part["id"].to_numpy()[at], "cell": to.astype(np.int32), "qv": pd.Series(list(x[at]), dtype=object)})

    asked = placed.join(bound, "id", "left").select("id", "v", "cell", "bound").mapInPandas(visits, "query_id long, cell int, qv array<double>")
    far = met(asked, placed, k + 1, False, block=block)
    near = own.select("query_id", "id", "score").unionByName(far.select("query_id", "id", "score"))
    best = Window.partitionBy("query_id").orderBy("score", "id")
    near = written(near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1), "near")
    # from points back to rows: each row of a point has the same candidates but for itself
    ids = distinct.select(F.col("id"), "keys")
    candidates = near.join(ids, "id").select("query_id", F.col("score").alias("distance"), F.explode("keys").alias("other"))
    order = Window.partitionBy("query_id").orderBy("distance", "other")
    candidates = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    lists = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("distance", "other"))).alias("all"))  # at most k + 1
    rows = values.join(distinct.select("v", F.col("id").alias("query_id")), "v").join(lists, "query_id")
    rest = F.slice(F.filter("all", lambda x: x["other"] != F.col("key")), F.lit(1), F.lit(k))
    return rows.select("key", F.posexplode(rest).alias("p", "x")).select("key", F.col("x.other").alias("other"), F.col("x.distance").alias("distance"), (F.col("p") + 1).alias("rank"))


# -- inverted file ---------------------------------------------------------------------------------


def unit_rows(df: DataFrame, v: str) -> Column:
    x = doubles(F.col(v))
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda m, y: m + y * y))
    return F.transform(x, lambda y: F.try_divide(y, length))


class VectorIndex:
    """An inverted file at ``path``: rows by cell, pivots, and how many cells a search visits.

    ``rows`` holds (cell, part, id, document, shown, v), a folder a cell and files of bounded size; ``pivots`` (cell, v);
    ``facts`` one row (rows, cells, probes, dims).  ``probes`` was measured when the index was built: so many cells hold the
    wanted share of the nearest neighbours of a bounded, documented sample of rows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        facts = spark.read.parquet(f"{path}/facts").first()
        self.n, self.cells, self.probes, self.dims = (facts[c] for c in ("rows", "cells", "probes", "dims"))
        self.pivots = np.array([r[0] for r in spark.read.parquet(f"{path}/pivots").orderBy("cell").select("v").collect()])  # at most MOST_CELLS

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema("id bigint, document bigint, shown string, v array<double>, cell int").parquet(f"{self.path}/rows")

    def visited(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(query_id, cell, qv) of ``queries`` (id, v): the nearest cells of each."""
        asked = queries.select(F.col("id").cast("long").alias("query_id"), unit_rows(queries, "v").alias("qv"))
        return in_cells(asked, "qv", self.pivots, probes or self.probes).select("query_id", "cell", "qv")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, documents: list[int] | None = None, exact: bool = False, others: bool = False) -> DataFrame:
        """(query_id, passage_id, document, score, rank) by cosine; with ``exact`` every cell is visited."""
        if documents is not None and not documents:
            raise ValueError("an empty filter finds nothing")
        rows = self.rows.where(F.col("document").isin(documents)) if documents is not None else self.rows
        visited = written(self.visited(queries, self.cells if exact else probes), "visited")
        cells = [r[0] for r in visited.select("cell").distinct().collect()]  # at most MOST_CELLS
        rows = rows.where(F.col("cell").isin(cells))  # folders of other cells aren't read
        found = met(visited, rows, k, True, others)
        return found.join(rows.select("id", "document"), "id").select("query_id", F.col("id").alias("passage_id"), "document", "score", "rank")

    def scanned_share(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """One row (queries, pairs, share): query-row pairs that a search compares, of all there are."""
        sizes = self.rows.groupBy("cell").agg(F.count("*").alias("n"))
        pairs = self.visited(queries, probes).join(F.broadcast(sizes), "cell").agg(F.count_distinct("query_id").alias("queries"), F.sum("n").alias("pairs"))
        return pairs.withColumn("share", F.col("pairs") / (F.col("queries") * F.lit(self.n)))


def build_inverted_file(chunks: DataFrame, path: str, cells: int | None = None, recall: float = 0.97, k: int = 10, sample: int = 256, seed: int = 42) -> VectorIndex:
    """Write an index of ``chunks`` (id, document, shown, v) at ``path``; no chunks is an error that leaves what is there.

    ``cells``: by default the root of the number of rows, ``MOST_CELLS`` at most.  ``probes`` is the least number of
    cells that hold ``recall`` of the exact ``k`` nearest neighbours of ``sample`` rows taken by hash.  Runs jobs.
    """
    spark = chunks.sparkSession
    if chunks.isEmpty():
        raise ValueError("an index needs chunks")
    kept = written(chunks.select(F.col("id").cast("long").alias("id"), F.col("document").cast("long").alias("document"), "shown", unit_rows(chunks, "v").alias("v")), "chunks")
    n = kept.count()
    cells = min(MOST_CELLS, cells or max(1, int(math.sqrt(n))))
    pivots = fit_pivots(kept, "v", cells, seed) if cells > 1 and n > 1 else np.array([kept.first()["v"]])
    placed = written(in_cells(kept, "v", pivots), "placed").drop("order", "reach")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / (16 * BLOCK)).alias("parts"))  # a row a cell
    split = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    split.repartition("cell", "part").drop("part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "cell int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")
    asked = kept.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "v")
    from .retrieval import top_k

    truth = top_k(asked, kept, k, dims=pivots.shape[1], others=True).select("query_id", F.col("passage_id").alias("id"))
    at = truth.join(placed.select("id", "cell"), "id").join(in_cells(asked.select(F.col("id").alias("query_id"), "v"), "v", pivots, len(pivots)).select("query_id", "cell", "order"), ["query_id", "cell"])
    reached = at.groupBy("order").count().orderBy("order").collect()  # at most a row a cell
    total, sum_, probes = sum(r["count"] for r in reached), 0, 1
    for r in reached:
        sum_ += r["count"]
        probes = r["order"] + 1
        if sum_ >= recall * total:
            break
    spark.createDataFrame([(n, len(pivots), probes, pivots.shape[1])], "rows long, cells int, probes int, dims int").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")
    return VectorIndex(spark, path)
