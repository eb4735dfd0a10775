import zlib
from collections import Counter, defaultdict

import pytest
from lakeglean.llm import sharding
from pyspark.sql import functions as F

DDL = "doc_id long, text string, size string, shard string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DDL).repartition(4)


def checked(rows, out, shards=sharding.SHARDS):
    raw = [b"" if t is None else t.encode() for _, t in rows]
    assert Counter((i, len(b) + 8, zlib.crc32(b)) for (i, _), b in zip(rows, raw, strict=True)) == Counter((r.doc_id, r.size, r.text_crc32) for r in out)
    slots = defaultdict(list)
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    loads = Counter()
    for r in out:
        loads[r.shard] += r.size
    return [loads[s] for s in range(shards)]


def spans(out):
    """Shards that rows of each repeated text take, by crc."""
    at = defaultdict(set)
    for r in out:
        if r.group_rows > 1:
            at[r.text_crc32].add(r.shard)
    return at


def test_pairs_and_groups_stay_together_and_sizes_are_even(spark):
    rows = [(i, f"text {i % 900} " * (i % 900 % 17 + 1)) for i in range(1800)] + [(i, f"single {i} " * (i % 23)) for i in range(5000, 8000)]
    rows += [(None, None), (None, None), (1, ""), (1, ""), (9000, "x" * 2000)]
    out = sharding.sharded(table(spark, rows)).collect()
    loads = checked(rows, out)
    assert max(loads) - min(loads) < 0.01 * sum(loads) / 24
    at = spans(out)
    # of random labels one pair in 24 would stay together
    assert len(at) == 901 and sum(len(s) == 1 for s in at.values()) >= 0.99 * len(at)


def test_a_group_of_a_third_takes_as_few_shards_as_fit(spark):
    rows = [(i, "the same text, again and again") for i in range(1500)] + [(i, f"{i} is a text of its own, some") for i in range(2000, 5000)]
    out = sharding.sharded(table(spark, rows)).collect()
    loads = checked(rows, out)
    assert max(loads) - min(loads) <= 80
    (shards,) = spans(out).values()
    assert len(shards) <= 10  # 8.2 quotas


def test_repeated_rows_are_split_too(spark):
    rows = [(7, "one row")] * 2000 + [(i, f"row {i}") for i in range(100, 1100)]
    loads = checked(rows, sharding.sharded(table(spark, rows)).collect())
    assert max(loads) - min(loads) <= 40


def test_very_long_texts_and_few_rows(spark):
    rows = [(1, "a" * 100_000), (2, "b" * 30_000), (3, "c"), (4, "c")]
    out = sharding.sharded(table(spark, rows)).collect()
    checked(rows, out)
    assert sharding.sharded(table(spark, rows[:0])).count() == 0
    assert [(r.shard is not None, r.slot) for r in sharding.sharded(table(spark, rows[:1])).collect()] == [(True, 0)]


def test_rows_of_several_hubs_follow_the_sum_of_votes(spark):
    """Two communities that share few links: nearly all links end inside a shard."""
    rows = spark.range(400).select(F.col("id").alias("row"), F.lit(10).cast("long").alias("size"), F.pmod(F.xxhash64("id"), F.lit(4)).cast("int").alias("shard"))
    links = spark.range(400).select(F.col("id").alias("row"), F.explode(F.array(F.concat(F.lit("a"), (F.col("id") / 40).cast("int").cast("string")), F.concat(F.lit("b"), (F.col("id") / 20).cast("int").cast("string")))).alias("hub"))
    got = {r.row: r.shard for r in sharding.propagate(rows, links, 1000, 4).collect()}
    before = {r.row: r.shard for r in rows.collect()}
    assert max(Counter(got.values()).values()) <= max(100, *Counter(before.values()).values()) + 12

    def cut(at, width):
        return sum(len({at[i] for i in range(k, k + width)}) - 1 for k in range(0, 400, width))

    assert cut(before, 20) >= 55 and cut(got, 20) <= 20 and cut(got, 40) <= 12


@pytest.mark.parametrize("n", [0, 5])
def test_largest_first(spark, n):
    sizes = [9, 7, 7, 4, 1][:n]
    rows = spark.createDataFrame(list(enumerate(sizes)), "row long, size long")
    room = spark.createDataFrame([(0, 10), (1, 12), (2, 7)], "shard int, room long")
    left = [10, 12, 7]
    expected = {}
    for i, s in enumerate(sizes):
        at = left.index(max(left))
        left[at] -= s
        expected[i] = at
    assert {r.row: r.shard for r in sharding.one_by_one(rows, room).collect()} == expected
