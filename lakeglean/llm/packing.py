"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted and optimised together.  Documents longer than the largest
are cut into pieces; pieces, longest first, go to the open bin with the least room that is enough
(best fit).  If there is none, the bin of the least cost is opened.  A sequence of c tokens costs
``overhead + c + c * c / quadratic``: linear work for every token, padding included, attention that grows with
the square, and a fixed part.  Long sequences have less overhead and are filled more tightly, short ones
cost less attention, so each capacity is the best one for some pieces.

The cost of opening a capacity is judged by what the bin will hold: the piece and, as far as they fit, the
longest pieces that are still to come, from the exact remaining lengths; the capacity with the least
cost per token held is opened.  At the end every bin shrinks to the smallest permitted length that
holds its contents.

Only (document, piece, length) rows move.  They are dealt by hash into shards of about
``shard_rows`` pieces, equal rows that are many by their place in the table; a shard is packed in one
task, in memory that its bound fixes, and the number of shards grows with the input.  Waste comes
from the last bins of a shard only.  ``shard_rows`` None packs all pieces in one task.

Defined cases: null text and length 0 make no piece; repeated rows are documents of their own; a null
id is kept; of equal lengths the first by id, then piece, is packed first; extra columns are ignored; an
empty table packs to nothing.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 64.0
QUADRATIC = 8192.0
SHARD_ROWS = 50_000


def cost(capacity: int, overhead: float = OVERHEAD, quadratic: float = QUADRATIC) -> float:
    return overhead + capacity + capacity * capacity / quadratic


class Remaining:
    """The lengths of the pieces that are still to come, with their counts."""

    def __init__(self, lengths: list[int]):
        self.count: dict[int, int] = {}
        for n in lengths:
            self.count[n] = self.count.get(n, 0) + 1
        self.sizes = sorted(self.count)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            del self.count[n]
            del self.sizes[bisect_left(self.sizes, n)]

    def fill(self, room: int) -> int:
        """Tokens that the longest pieces that fit, one after the other, put into ``room``."""
        held, at = 0, bisect_right(self.sizes, room)
        while at:
            n = self.sizes[at - 1]
            k = min(self.count[n], (room - held) // n)
            held += k * n
            at = min(at - 1, bisect_right(self.sizes, room - held))
        return held


def pack(lengths: list[int], capacities=CAPACITIES, overhead: float = OVERHEAD, quadratic: float = QUADRATIC) -> tuple[list[int], list[int], list[int], list[int]]:
    """(bin, offset) of each piece, the capacity of each bin and the one it was opened with; best fit,
    longest piece first."""
    sizes = sorted(capacities)
    price = {c: cost(c, overhead, quadratic) for c in sizes}
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    rooms: list[int] = []  # the distinct rooms of open bins, ascending
    bins_by_room: dict[int, list[int]] = {}
    used: list[int] = []
    opened: list[int] = []
    bin_of, offset = [0] * len(lengths), [0] * len(lengths)
    coming = Remaining(lengths)
    for i in order:
        n = lengths[i]
        coming.take(n)
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = bins_by_room[room].pop()
            if not bins_by_room[room]:
                del bins_by_room[room], rooms[at]
        else:
            fits = sizes[bisect_left(sizes, n) :]
            held = {c: n + coming.fill(c - n) for c in fits}
            # a bin that is not filled will shrink
            final = {c: price[sizes[bisect_left(sizes, held[c])]] for c in fits}
            c = min(fits, key=lambda c: (final[c] / held[c], c))
            b, room = len(used), c
            used.append(0)
            opened.append(c)
        bin_of[i], offset[i] = b, used[b]
        used[b] += n
        if left := room - n:
            if left not in bins_by_room:
                bins_by_room[left] = []
                insort(rooms, left)
            bins_by_room[left].append(b)
    return bin_of, offset, [sizes[bisect_left(sizes, u)] for u in used], opened


def packed(docs: DataFrame, length: Column, capacities=CAPACITIES, overhead: float = OVERHEAD, quadratic: float = QUADRATIC, shard_rows: int | None = SHARD_ROWS) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, bin_offset, capacity): where each piece of a document lies.

    ``start`` and ``length`` are in tokens of the document; ``bin_id`` is shard:number.
    """
    from .scratch import Scratch

    spark, most = docs.sparkSession, max(capacities)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), length.cast("long").alias("n")).where("n > 0")
    pieces = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most).cast("long"), F.col("n") - F.col("piece") * most).alias("length"))
    scratch = Scratch(spark, "packing")
    pieces = scratch.cut(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-pieces.count() // shard_rows)) if shard_rows else 1
    same = ["doc_id", "piece", "length"]
    if shards > 1:  # equal rows have one hash; where they are many, their place in the written table deals them
        many = pieces.groupBy(*same).agg(F.count("*").alias("n")).where(F.col("n") > max(1, shard_rows // 20))
        many = many.select(F.xxhash64(*same).alias("many")).distinct()
        pieces = pieces.withColumn("key", F.xxhash64(*same)).join(many, F.col("key") == F.col("many"), "left")
        key = F.when(F.col("many").isNull(), F.col("key")).otherwise(F.xxhash64("key", "row"))
        dealt = pieces.select(*same, "start", F.pmod(key, F.lit(shards)).cast("int").alias("shard"))
    else:
        dealt = pieces.select(*same, "start", F.lit(0).alias("shard"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "piece", "length"]).reset_index(drop=True)
        bins, offsets, sizes, _ = pack(part["length"].tolist(), capacities, overhead, quadratic)
        shard = part["shard"].iloc[0]
        part["bin_id"] = [f"{shard}:{b}" for b in bins]
        part["bin_offset"] = offsets
        part["capacity"] = [sizes[b] for b in bins]
        return part[["doc_id", "piece", "start", "length", "bin_id", "bin_offset", "capacity"]]

    return dealt.groupBy("shard").applyInPandas(run, "doc_id long, piece long, start long, length long, bin_id string, bin_offset long, capacity int")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import word_count

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_count(F.col("text")))
