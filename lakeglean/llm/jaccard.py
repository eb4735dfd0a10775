"""Exact n-gram Jaccard join with token-combination prefixes, and the classes its links form.

A document is its set of distinct five-word shingles.  Two documents link when
``100 * |a & b| >= 75 * |a | b|``.  Method:

1. *Hot tokens.*  One pass counts shingles inside every task and reports those that occur twice or
   more in it; summed up, these are the shingles that are frequent anywhere.  The at most
   ``hot_tokens`` most frequent (a proven bound) are broadcast and stand last in the global order
   (by power of two of their count, then hash); all others come first, by hash.
2. *Extended prefixes.*  A set of n shingles loses at most ``d = n - ceil(0.75 n)`` of them to any
   partner, so a partner shares one of the first d + 1 in the global order.  The prefix is
   extended so that combinations suffice for frequent tokens: the frequent tokens of a prefix fall
   into G subclasses by hash (G by size level, so that a subclass holds several tokens), and a
   prefix is long enough when ``rare + sum(max(0, s_j - 1)) > d``; then every partner shares a
   rare token or two tokens of one subclass inside both prefixes.
3. *Index.*  Rare tokens (at most ``rare`` postings in prefixes) are indexed alone, frequent ones as
   pairs within a subclass.  A token's class depends on its number of postings, which is global.
4. *Verify.*  Candidates whose sizes, positions, bitmaps or shared entries rule a link out are
   dropped; the others are verified on whole sets.  Components are all that is wanted, so a
   candidate whose two sides are known to be connected need not be verified.  First every set is
   compared with the most central set that shares an entry with it (whose shingles are the most
   common), then with the most central one of each of its entries; entries some of whose sets are
   still apart from that one are compared across components.  No pair that could link two
   components is left out, and copies never form pairs: equal sets are one node.

Defined cases: no words, null or empty text: no shingles, a component of its own.  Repeated rows
are copies.  A null ``doc_id`` counts as larger than all others.  Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as nw
from .scratch import Scratch

WIDTH = 5
HOT_TOKENS = 1 << 18
#: Postings that a rare token has at most, and the count from which a token is ordered behind others.
RARE = 1000
OFTEN = 8
BLOOM_BITS = 1 << 24
#: Bits of a set's bitmap, in words of 64.
BIT_WORDS = 16
_U = np.uint64


def _fingerprint(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits for each set of distinct shingles; 0 for the empty one."""
    sizes = np.diff(bounds)
    total = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if full.any():
        total[full] = np.add.reduceat(nw.mix(sets ^ _U(0x5851F42D4C957F2D)), bounds[:-1][full])
    return np.where(full, nw.mix(total + sizes.astype(np.uint64)), _U(0))


def _distinct(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashes sorted and without repeats."""
    parts = [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    out = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return (np.concatenate(parts) if parts else h[:0]), out


def _sets(batch: pa.RecordBatch, width: int):
    """(rows lo..hi, their sorted distinct shingles, bounds) block by block."""
    data, offsets = nw.buffers(batch.column(1))
    for lo, hi in nw.blocks(offsets):
        w, before = nw.word_hashes(data, offsets[lo : hi + 1])
        yield lo, hi, *_distinct(*nw.shingle_hashes(w, before, width))


def _bitmaps(sets: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """For each set the bits that its shingles' hashes fall on, as ``BIT_WORDS`` integers."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    slot = (sets % _U(BIT_WORDS * 64)).astype(np.int64)
    flat = np.zeros((len(bounds) - 1) * BIT_WORDS, np.uint64)
    np.bitwise_or.at(flat, rows * BIT_WORDS + (slot >> 6), _U(1) << (slot & 63).astype(np.uint64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(bounds)) * BIT_WORDS, pa.int32()), pa.array(flat.view(np.int64)))


def _survey(width: int):
    """Rows (doc_id, n, fp, bits) of documents, and (token, count) of shingles that a task met twice."""
    bits_type = pa.list_(pa.int64())

    def run(batches):
        kept: list[np.ndarray] = []
        held = 0
        totals: dict[str, np.ndarray] = {"t": np.zeros(0, np.uint64), "c": np.zeros(0, np.int64)}

        def fold() -> pa.RecordBatch:
            t, c = np.unique(np.concatenate(kept), return_counts=True)
            often = c > 1
            totals["t"], totals["c"] = t[often], c[often]
            kept.clear()
            k = len(totals["t"])
            return pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, bits_type), pa.array(totals["t"].view(np.int64)), pa.array(totals["c"])],
                names=["doc_id", "n", "fp", "bits", "token", "count"],
            )

        for batch in batches:
            ids = batch.column(0)
            for lo, hi, sets, bounds in _sets(batch, width):
                kept.append(sets)
                held += len(sets)
                m = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, m), pa.array(np.diff(bounds)), pa.array(_fingerprint(sets, bounds).view(np.int64)), _bitmaps(sets, bounds), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())],
                    names=["doc_id", "n", "fp", "bits", "token", "count"],
                )
                if held > 2_000_000:
                    yield fold()
                    held = 0
        if kept:
            yield fold()

    return run


def subclasses(level: np.ndarray | int):
    """G of a size level: about one subclass for every 32 shingles of the smallest set in it."""
    return np.maximum(1, (1 << np.asarray(level)) // 32)


def slack(n):
    """n - ceil(0.75 n): what a set of n shingles can lack in a partner."""
    return n - (3 * n + 3) // 4


def _prefixes(width: int, hot_bytes: bytes, level_bytes: bytes):
    """Rows (node, n, c, pos, token) of the extended prefix of each set; copies within a task once.

    c is the set's mean level: what most of its like share counts high, what is its own low.
    """

    def run(batches):
        hot, level = np.frombuffer(hot_bytes, np.uint64), np.frombuffer(level_bytes, np.uint8)
        seen: set[int] = set()
        for batch in batches:
            for _lo, _hi, sets, bounds in _sets(batch, width):
                fps = _fingerprint(sets, bounds).view(np.int64)
                if len(hot):
                    where = np.minimum(np.searchsorted(hot, sets), len(hot) - 1)
                    rank = np.where(hot[where] == sets, level[where], 0)
                else:
                    rank = np.zeros(len(sets), np.uint8)
                out = []
                for i, fp in enumerate(fps.tolist()):
                    n = int(bounds[i + 1] - bounds[i])
                    if n == 0 or fp in seen:
                        continue
                    seen.add(fp)
                    tokens, r = sets[bounds[i] : bounds[i + 1]], rank[bounds[i] : bounds[i + 1]]
                    if r.any():
                        tokens = tokens[np.argsort(r, kind="stable")]
                    out.append((fp, n, int(r.mean() * 1000), tokens[: slack(n) + 2 + max(1, n // 32)]))
                if not out:
                    continue
                lens = np.array([len(t) for *_, t in out])
                pos = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array([x[0] for x in out]), lens)),
                        pa.array(np.repeat(np.array([x[1] for x in out]), lens).astype(np.int32)),
                        pa.array(np.repeat(np.array([x[2] for x in out]), lens).astype(np.int32)),
                        pa.array(pos.astype(np.int32)),
                        pa.array(np.concatenate([t for *_, t in out]).view(np.int64)),
                    ],
                    names=["node", "n", "c", "pos", "token"],
                )

    return run


def entries(n: int, pos: np.ndarray, tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index entries, what of the set can be shared where the entry is the first shared one).

    Rare tokens alone; frequent ones as pairs within subclasses, by size level, up to the prefix
    length that suffices.  ``rest`` of a rare token is the set without the rare tokens before it;
    of a pair, without the rare tokens before its first one and without the frequent ones before
    that beyond one a subclass.
    """
    d = slack(n)
    order = np.argsort(pos)
    pos, tokens, frequent = pos[order], tokens[order].view(np.uint64), frequent[order]
    earlier = np.cumsum(frequent) - frequent  # frequent ones before each
    sigs, rests = [tokens[~frequent].view(np.int64)], [n - pos[~frequent] + earlier[~frequent]]
    pos, tokens, earlier = pos[frequent], tokens[frequent], earlier[frequent]
    for lev in {n.bit_length() - 1, ((3 * n + 3) // 4).bit_length() - 1}:
        g = int(subclasses(lev))
        sub = (nw.mix(tokens ^ _U(lev + 1)) % _U(g)).astype(np.int64)
        # the number of frequent tokens that count: all but the first of each subclass
        repeat = np.ones(len(sub), np.int64)
        repeat[np.unique(sub, return_index=True)[1]] = 0
        # at prefix length p (1-based) the rare ones are p minus the frequent ones
        worth = pos + 1 - np.arange(1, len(pos) + 1) + np.cumsum(repeat)
        reach = np.flatnonzero(worth > d)
        keep = len(pos) if not len(reach) else int(reach[0]) + 1
        by = np.argsort(sub[:keep], kind="stable")
        s, t = sub[:keep][by], tokens[:keep][by]
        rest = (n - pos[:keep] + np.minimum(earlier[:keep], g))[by]
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1, [len(s)]])
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo > 1:
                i, j = np.triu_indices(hi - lo, 1)
                x, y = t[lo:hi][i], t[lo:hi][j]
                sigs.append(nw.mix(np.minimum(x, y) * _U(0x9E3779B97F4A7C15) + nw.mix(np.maximum(x, y)) + _U(lev)).view(np.int64))
                rests.append(rest[lo:hi][i])
    return np.concatenate(sigs), np.concatenate(rests)


def _combine(batches):
    """(node, n, c, [(pos, token, frequent)]) to (sig, node, n, c, rest)."""
    for batch in batches:
        nodes, ns, cs = (batch.column(i).to_numpy() for i in range(3))
        lists = batch.column(3)
        offsets = lists.offsets.to_numpy()
        inner = lists.values
        pos, token, frequent = inner.field(0).to_numpy(), inner.field(1).to_numpy(), inner.field(2).to_numpy(zero_copy_only=False)
        for i in range(len(nodes)):
            a, b = offsets[i], offsets[i + 1]
            _, once = np.unique(pos[a:b], return_index=True)
            sig, rest = entries(int(ns[i]), pos[a:b][once].astype(np.int64), token[a:b][once], frequent[a:b][once])
            for k in range(0, len(sig), 100_000):
                part = sig[k : k + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(np.full(len(part), nodes[i])), pa.array(np.full(len(part), ns[i], np.int32)), pa.array(np.full(len(part), cs[i], np.int32)), pa.array(rest[k : k + 100_000].astype(np.int32))],
                    names=["sig", "node", "n", "c", "rest"],
                )


def _whole_sets(width: int, bits: bytes):
    """(node, low and high halves of the set) of documents whose fingerprint may be wanted; copies
    within a task once."""

    def run(batches):
        bloom = np.frombuffer(bits, np.uint64)
        seen: set[int] = set()
        for batch in batches:
            for _lo, _hi, sets, bounds in _sets(batch, width):
                fps = _fingerprint(sets, bounds)
                slot = fps % _U(len(bloom) * 64)
                may = (bloom[slot >> _U(6)] >> (slot & _U(63))) & _U(1)
                rows = []
                for i in np.flatnonzero(may):
                    fp = int(fps[i : i + 1].view(np.int64)[0])
                    if fp not in seen:
                        seen.add(fp)
                        rows.append((fp, sets[bounds[i] : bounds[i + 1]].view(np.int64)))
                if rows:
                    lens = np.array([len(s) for _, s in rows])
                    at, flat = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), np.concatenate([s for _, s in rows])
                    low = pa.ListArray.from_arrays(at, pa.array(flat.astype(np.int32)))
                    high = pa.ListArray.from_arrays(at, pa.array((flat >> 32).astype(np.int32) + (flat.astype(np.int32) < 0)))
                    yield pa.RecordBatch.from_arrays([pa.array([fp for fp, _ in rows], pa.int64()), low, high], names=["node", "low", "high"])

    return run


def _sets_of(texts: DataFrame, sides: DataFrame, width: int, scratch: Scratch, k: int) -> DataFrame:
    """(node, low, high) of the nodes of ``sides``: their shingles' halves, made anew from the texts.

    A Bloom filter of fixed size keeps most other sets from leaving the workers; those that pass
    it by chance join nothing later.
    """
    slots = sides.select(F.pmod(F.col("node"), F.lit(BLOOM_BITS)).alias("slot"))
    filled = slots.groupBy(F.floor(F.col("slot") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    bloom = np.zeros(BLOOM_BITS // 64, np.int64)
    bloom[filled["word"].to_numpy().astype(np.int64)] = filled["bits"].to_numpy().astype(np.int64)
    sets = texts.mapInArrow(_whole_sets(width, bloom.tobytes()), "node long, low array<int>, high array<int>")
    return scratch.cut(sets.dropDuplicates(["node"]), f"sets-{k}")


def _close() -> Column:
    return F.least("n", "m") * 4 >= F.greatest("n", "m") * 3


def _bit_bound(n: Column, mine: Column, theirs: Column) -> Column:
    """What two sets share at most: a bit of mine that theirs lacks stands for a shingle that they lack."""
    lacking = [F.bit_count(mine[i].bitwiseAND(F.bitwise_not(theirs[i]))) for i in range(BIT_WORDS)]
    return n - sum(lacking[1:], lacking[0])


def _across(loose: DataFrame, heads: DataFrame) -> DataFrame:
    """Candidates (node, other, n, m) of different components that share an entry.

    Those of an entry's largest component are not compared with each other, so only the other
    sets look for partners: by an equi-join on entry and size band, 3/4 to 4/3 of their own size.  If
    the entry is the first that two sets share, they share at most the lesser ``rest``; and by
    their bitmaps they share at most what ``_bit_bound`` says.
    """
    width = float(np.log(1.08))

    def band(n: Column) -> Column:
        return F.floor(F.log(n.cast("double")) / width).cast("int")

    sizes = loose.groupBy("sig", "l").agg(F.count("*").alias("k"))
    big = sizes.groupBy("sig").agg(F.max_by("l", F.struct("k", "l")).alias("big"))
    own = loose.join(big, "sig").join(heads.select("node", "bits"), "node").withColumn("most", F.floor(F.col("rest") * 7 / 3) - F.col("n"))
    low, top = F.ceil(F.col("n") * 3 / 4), F.least(F.floor(F.col("n") * 4 / 3), F.col("most"))
    asking = own.where(F.col("l") != F.col("big")).where(top >= low).withColumn("band", F.explode(F.sequence(band(low), band(top))))
    asked = own.select("sig", band(F.col("n")).alias("band"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("l").alias("l1"), F.col("most").alias("most1"), F.col("bits").alias("bits1"))
    once = (F.col("l1") == F.col("big")) | (F.col("other") < F.col("node"))
    fits = (F.col("l") != F.col("l1")) & once & (F.col("m") <= F.col("most")) & (F.col("n") <= F.col("most1"))
    need = (F.col("n") + F.col("m")) * 3
    bits, bits1 = F.col("bits"), F.col("bits1")
    fits = fits & (_bit_bound(F.col("n"), bits, bits1) * 7 >= need) & (_bit_bound(F.col("m"), bits1, bits) * 7 >= need)
    pairs = asking.join(asked, (asking["sig"] == asked["sig"]) & (asking["band"] == asked["band"]) & fits)
    return pairs.select("node", "other", "n", "m").distinct()


def _plausible(found: DataFrame, heads: DataFrame, *keep: str) -> DataFrame:
    """Candidates (node, other, n, m) whose sizes, bitmaps and prefixes allow a link.

    With the first p = slack + 1 tokens in the global order, all of them indexed, two sets share at
    most what these share and what the larger of the two rests, n - p, can add.
    """

    def rest(n: str) -> Column:
        return F.ceil(F.col(n) * 3 / 4) - 1

    x = heads.select("node", F.col("sigs").alias("x"), F.col("spare").alias("sx"), F.col("bits").alias("bx"))
    y = heads.select(F.col("node").alias("other"), F.col("sigs").alias("y"), F.col("spare").alias("sy"), F.col("bits").alias("by_"))
    both = found.where(_close()).join(x, "node")
    need = (F.col("n") + F.col("m")) * 3
    most = F.size(F.array_intersect("x", "y")) + F.least("sx", "sy") + F.greatest(rest("n"), rest("m"))
    bits = (_bit_bound(F.col("n"), F.col("bx"), F.col("by_")) * 7 >= need) & (_bit_bound(F.col("m"), F.col("by_"), F.col("bx")) * 7 >= need)
    return both.join(y, (both["other"] == y["other"]) & bits & (most * 7 >= need)).select("node", both["other"], "n", "m", *keep)


def _verified(found: DataFrame, sets: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """(node, other, linked) of candidates (node, other, n, m), exactly.

    Lower halves of the hashes decide all but close cases: chance matches of 32 bits are fewer
    than the margin.  Close cases are decided on whole hashes.
    """
    half = sets.select("node", "low")
    both = found.join(half.withColumnRenamed("low", "x"), "node").join(half.select(F.col("node").alias("other"), F.col("low").alias("y")), "other")
    margin = F.lit(3) + F.ceil(F.col("n").cast("double") * F.col("m") / 2**29)
    judged = both.select("node", "other", "n", "m", F.size(F.array_intersect("x", "y")).alias("shared"), margin.alias("margin"))
    need = (F.col("n") + F.col("m")) * 3
    linked = F.when((F.col("shared") - F.col("margin")) * 7 >= need, True).when((F.col("shared") + F.col("margin")) * 7 < need, False)
    judged = scratch.cut(judged.select("node", "other", "n", "m", linked.alias("linked")), f"judged-{k}")
    close = judged.where("linked IS NULL").drop("linked")
    whole = sets.select("node", F.zip_with("high", "low", lambda h, x: F.shiftleft(h.cast("long"), 32) + x).alias("t"))
    exact = close.join(whole.withColumnRenamed("t", "x"), "node").join(whole.select(F.col("node").alias("other"), F.col("t").alias("y")), "other")
    exact = exact.select("node", "other", (F.size(F.array_intersect("x", "y")) * 7 >= need).alias("linked"))
    return scratch.cut(judged.where("linked IS NOT NULL").select("node", "other", "linked").unionByName(exact), f"verified-{k}")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of ``edges`` (a, b).

    Alternating large-star and small-star steps; each round is written, and the rounds end when
    one changes nothing, however many they are.
    """
    e = scratch.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    state = None
    for k in itertools.count(1):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b")
        nxt = scratch.cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{k}")
        now = nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        scratch.drop(f"{name}-{k - 1}")
        e = nxt
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).unionByName(roots)


@dataclass
class Index:
    """The index of a table: its rows' sets, entries, and what bounds a candidate's overlap."""

    texts: DataFrame  # (doc_id, text)
    rows: DataFrame  # (doc_id, n, fp)
    entries: DataFrame  # (sig, node, n, rest, low, low_n, low_rest, low_c, many)
    heads: DataFrame  # (node, sigs, spare, bits)
    scratch: Scratch
    width: int


def build(docs: DataFrame, width: int = WIDTH, hot_tokens: int = HOT_TOKENS, rare: int = RARE, often: int = OFTEN) -> Index:
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    survey = scratch.cut(texts.mapInArrow(_survey(width), "doc_id long, n long, fp long, bits array<long>, token long, count long"), "survey")
    rows_of = survey.where("n is not null")
    rows = rows_of.select("doc_id", "n", "fp")
    counted = survey.where("token is not null").groupBy("token").agg(F.sum("count").alias("c"))
    hot = counted.where(F.col("c") > often).orderBy(F.desc("c"), "token").limit(hot_tokens).select("token", F.floor(F.log2("c")).cast("int").alias("level")).toArrow()
    tokens, level = hot["token"].to_numpy().astype(np.int64).view(np.uint64), hot["level"].to_numpy().astype(np.uint8)
    order = np.argsort(tokens)

    prefixes = texts.mapInArrow(_prefixes(width, tokens[order].tobytes(), level[order].tobytes()), "node long, n int, c int, pos int, token long")
    held = F.count("*").over(Window.partitionBy("token"))
    postings = scratch.cut(prefixes.withColumn("f", held).where("f > 1").select("token", "node", "n", "c", "pos", (F.col("f") > rare).alias("frequent")), "postings")
    spare = scratch.cut(postings.where("frequent").groupBy("node").agg(F.count("*").alias("spare")), "spare")
    marked = postings.join(spare, "node", "left")
    single = marked.where("spare IS NULL").select(F.col("token").alias("sig"), "node", "n", "c", (F.col("n") - F.col("pos")).alias("rest"))
    pairs = marked.where("spare IS NOT NULL").groupBy("node", "n", "c").agg(F.collect_list(F.struct("pos", "token", "frequent")).alias("t")).mapInArrow(_combine, "sig long, node long, n int, c int, rest int")
    by_sig = Window.partitionBy("sig")
    # an entry whose rest is below 3/4 of the set can't be the first that a linked pair shares
    index = single.unionByName(pairs).where("rest * 4L >= n * 3L")
    pivot = F.max(F.struct("c", "node", "n", "rest")).over(by_sig)
    index = index.withColumns({"p": pivot, "high": F.max("node").over(by_sig), "low": F.min("node").over(by_sig), "size": F.count("*").over(by_sig)}).where("low <> high")
    index = scratch.cut(index.select("sig", "node", "n", "rest", F.col("p.node").alias("low"), F.col("p.n").alias("low_n"), F.col("p.rest").alias("low_rest"), F.col("p.c").alias("low_c"), (F.col("size") > 2).alias("many")), "index")
    # a set's own entries: all that its prefix can share with another's, but for frequent tokens
    heads = index.groupBy("node").agg(F.collect_set("sig").alias("sigs")).join(spare, "node", "left").withColumn("spare", F.coalesce("spare", F.lit(0)))
    bitmaps = rows_of.groupBy(F.col("fp").alias("node")).agg(F.first("bits").alias("bits"))
    heads = scratch.cut(heads.join(bitmaps, "node"), "heads")
    scratch.drop("postings")
    return Index(texts, rows, index, heads, scratch, width)


def shingle_links(docs: DataFrame, **options) -> DataFrame:
    """(doc_a, doc_b, class_a, class_b): every link between different sets, each once, by the
    smallest document of each class (see ``shingle_classes`` for the classes' members).

    All links of n near copies are of order n squared; ``shingle_classes`` doesn't need them.
    """
    x = build(docs, **options)
    two = x.entries.where("NOT many AND node <> low").select("node", F.col("low").alias("other"), "n", F.col("low_n").alias("m"))
    every = x.entries.where("many").select("sig", "node", "n", "rest", F.col("node").alias("l")).distinct()
    found = x.scratch.cut(_plausible(two.unionByName(_across(every, x.heads)).distinct(), x.heads), "found")
    sets = _sets_of(x.texts, found.select("node").unionByName(found.select(F.col("other").alias("node"))).distinct(), x.width, x.scratch, 0)
    linked = _verified(found, sets, x.scratch, 0).where("linked").select(F.least("node", "other").alias("class_a"), F.greatest("node", "other").alias("class_b")).distinct()
    first = x.rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc"))
    out = linked.join(first.select(F.col("fp").alias("class_a"), F.col("doc").alias("doc_a")), "class_a")
    return out.join(first.select(F.col("fp").alias("class_b"), F.col("doc").alias("doc_b")), "class_b").select("doc_a", "doc_b", "class_a", "class_b")


def shingle_classes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) for each row of ``docs`` (doc_id, text)."""
    x = build(docs, **options)
    texts, rows, index, heads, scratch, width = x.texts, x.rows, x.entries, x.heads, x.scratch, x.width
    # every set against the most central set of each of its index entries, once
    reach = F.max(F.least("rest", "low_rest")).alias("reach")
    stars = index.where("node <> low").groupBy("node", F.col("low").alias("other")).agg(F.first("n").alias("n"), F.first("low_n").alias("m"), F.first("low_c").alias("c"), reach)
    stars = scratch.cut(stars, "stars")
    near = scratch.cut(_plausible(stars.where("reach * 7L >= (n + m) * 3L"), heads, "c"), "near")
    sets: DataFrame | None = None
    links: DataFrame | None = None
    labels: DataFrame | None = None
    tried: DataFrame | None = None

    def label(df: DataFrame, column: str, name: str) -> DataFrame:
        if labels is None:
            return df.withColumn(name, F.col(column))
        return df.join(labels.select(F.col("node").alias(column), F.col("label").alias("__label")), column, "left").withColumn(name, F.coalesce("__label", column)).drop("__label")

    def apart(df: DataFrame) -> DataFrame:
        """Pairs (node, other, ...) whose sides aren't known to be connected."""
        return label(label(df, "node", "l0"), "other", "l1").where("l0 <> l1").drop("l0", "l1")

    for k in range(3):
        if k == 0:  # one pair for each set: with the least other set of all
            found = near.groupBy("node", "n").agg(F.max(F.struct("c", "other", "m")).alias("o")).select("node", F.col("o.other").alias("other"), "n", F.col("o.m").alias("m"))
        elif k == 1:  # what is left of the stars
            found = apart(near.drop("c"))
        else:  # entries of several sets, one of which isn't connected to the least: all pairs across
            loose = apart(stars).select("node", F.col("other").alias("low"))
            open_sigs = index.where("many").join(loose, ["node", "low"], "left_semi").select("sig").distinct()
            loose = label(index.where("many").join(open_sigs, "sig", "left_semi").select("sig", "node", "n", "rest"), "node", "l").distinct()
            loose = scratch.cut(loose, "loose")
            found = _plausible(_across(loose, heads), heads)
        if tried is not None:
            found = found.join(tried, ["node", "other"], "left_anti")
        found = scratch.cut(found, f"found-{k}")
        if found.isEmpty():
            continue
        if k == 0 or k == 2:  # the first two rounds compare the same sets
            pairs_of = near if k == 0 else found
            sets = _sets_of(texts, pairs_of.select("node").unionByName(pairs_of.select(F.col("other").alias("node"))).distinct(), width, scratch, k)
        verified = _verified(found, sets, scratch, k)
        scratch.drop(f"found-{k}", f"judged-{k}")
        if k:
            scratch.drop("sets-0", "sets-2")
        mine = verified.where("linked").select(F.col("node").alias("a"), F.col("other").alias("b"))
        links = mine if links is None else links.unionByName(mine)
        tried_now = verified.select("node", "other").unionByName(verified.select(F.col("other").alias("node"), F.col("node").alias("other")))
        tried = tried_now if tried is None else tried.unionByName(tried_now)
        labels = scratch.cut(components(links, scratch, f"edges{k}"), f"labels-{k}")
    scratch.drop("index", "heads", "stars", "near", "loose", "spare", "sets-0", "sets-2")

    out = rows.withColumn("node", F.when(F.col("n") > 0, F.col("fp")))
    if labels is None:
        out = out.withColumn("group", F.col("node"))
    else:
        out = out.join(labels, "node", "left").withColumn("group", F.coalesce("label", "node"))
    # partial minima, written, so that the join behind them is one that AQE can split where a
    # component is hot
    least = scratch.cut(out.where("n > 0").groupBy("group").agg(F.min("doc_id").alias("component_id")), "least")
    return out.join(least, "group", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("node", F.lit(0)).alias("class_id")
    )


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("class_id")


#: Plain SQL: all pairs of sets that share a shingle, then closure.
ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh
  FROM w),
k AS (SELECT min(doc_id) AS node, list_sort(sh) AS sh, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh), len(sh)),
m AS (SELECT s.doc_id, k.node FROM s JOIN k ON list_sort(s.sh) = k.sh),
t AS (SELECT node, n, unnest(sh) AS g FROM k),
p AS (SELECT a.node AS x, b.node AS y FROM t a JOIN t b ON a.g = b.g AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
r(node, root) AS (SELECT node, node FROM k UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node WHERE r.root < e.y),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, CAST(coalesce(c.root, s.doc_id) AS BIGINT) AS component_id
FROM s LEFT JOIN m ON m.doc_id = s.doc_id LEFT JOIN c ON c.node = m.node
"""
