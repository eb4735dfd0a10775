"""Document fingerprints by Order MinHash, sensitive to edit distance.

A text's k-mers (of UTF-8 bytes) are numbered by occurrence and hashed, so repeats stay apart.  The
hash space is cut into ``slots`` equal parts; in each, the ``order`` smallest hashes are taken, put
back in the order in which they stand in the text, and the tuple is hashed to 16 bits.  Two texts
agree in a slot only if they share those k-mers in the same order.  The likeness of two fingerprints is the
share of slots that agree, among those that either text fills.

One pass hashes a text once, whatever the number of slots.  The next document in descending id
order comes from a range partitioning by id and hash of the text: the ranges are as many as the texts'
bytes need (``range_bytes`` each, ``MAX_RANGES`` at most), their bounds are keys of existing rows, found by a
range sort of the keys alone.  Each range is a partition of its own, streamed in order by one task, and
the first document of a range is also sent to the range before it.

Defined cases: a null text is empty; an empty text has the empty signature (all slots 0000), like
only to another empty one; texts shorter than k are one k-mer; null ids come last; rows of equal id
are ordered by a hash of their text, so only rows that are equal must lie in one range; a single row is its
own next document; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import mix

K = 12
SLOTS = 64
ORDER = 2
RANGE_BYTES = 16 << 20
#: Bounds are literals of the plan, so there are not more of them; a range of any size is streamed.
MAX_RANGES = 10_000
_U = np.uint64
_CODE = np.random.Generator(np.random.PCG64(31)).integers(1, 2**63, 256, dtype=np.int64).view(np.uint64)


def kmer_hashes(data: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of each window of k bytes (of the whole, if shorter); windows double in width."""
    h, width, q = _CODE[data], 1, 0x9E3779B97F4A7C15
    k = min(k, len(data))
    parts = []  # hashes of windows of 1, 2, 4 ... bytes
    while True:
        parts.append((width, h))
        if width * 2 > k:
            break
        h = h[:-width] * _U(pow(q, width, 2**64)) + h[width:]
        width *= 2
    n, at, out = len(data) - k + 1, 0, None
    for width, h in reversed(parts):
        while at + width <= k:
            piece = h[at : at + n]
            out = piece.copy() if out is None else out * _U(pow(q, width, 2**64)) + piece
            at += width
    return mix(out)


def numbered(h: np.ndarray) -> np.ndarray:
    """Hashes that also depend on the number of earlier occurrences of the same k-mer."""
    s = np.sort(h)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return mix(h)
    again = np.unique(again)
    where = np.minimum(np.searchsorted(again, h), len(again) - 1)
    at = np.flatnonzero(again[where] == h)
    group = where[at]
    order = np.argsort(group, kind="stable")
    g = group[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    occurrence = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    out = h.copy()
    out[at[order]] += occurrence.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    return mix(out)


def signature(text: bytes, slots: int = SLOTS, order: int = ORDER, k: int = K) -> np.ndarray:
    """16 bits for each slot; 0 for a slot that no k-mer falls into."""
    out = np.zeros(slots, np.uint16)
    if not text:
        return out
    h = numbered(kmer_hashes(np.frombuffer(text, np.uint8), k))
    shift = _U(64 - slots.bit_length() + 1)
    low = h & ((_U(1) << shift) - _U(1))
    # a first guess at what the smallest ones are; all are looked at if it leaves a slot short
    limit = (float(1 << int(shift))) * 10 * order * slots / max(1, len(h))
    pos = np.flatnonzero(low < _U(int(min(limit, 2.0**63))))
    slot = (h[pos] >> shift).astype(np.int64)
    if len(pos) < len(h) and np.bincount(slot, minlength=slots).min() < order:
        pos = np.arange(len(h))
        slot = (h >> shift).astype(np.int64)
    by = np.lexsort((low[pos], slot))
    slot, pos = slot[by], pos[by]
    start = np.searchsorted(slot, np.arange(slots))
    rank = np.arange(len(slot)) - start[slot]
    keep = rank < order
    slot, pos, rank = slot[keep], pos[keep], rank[keep]
    by = np.lexsort((pos, slot))  # back into text order
    slot, value = slot[by], h[pos[by]]
    start = np.searchsorted(slot, np.arange(slots))
    rank = np.arange(len(slot)) - start[slot]
    total = np.zeros(slots, np.uint64)
    for r in range(order):
        here = rank == r
        total[slot[here]] = mix(total[slot[here]] * _U(0xC2B2AE3D27D4EB4F) + value[here])
    full = np.unique(slot)
    out[full] = (total[full] % _U(65535) + _U(1)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the slots filled in either that agree; 1 if both are empty."""
    either = (a | b) != 0
    n = int(either.sum())
    return float(((a == b) & either).sum() / n) if n else 1.0


def _hex(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def _stream(batches):
    """Rows (pid, sentinel, doc_id, text) in order to fingerprints of each and its edited text."""
    held = None  # (pid, doc_id, text, signature) of the row that waits for its next one
    fields = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for batch in batches:
        out = []
        for pid, sentinel, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if held is None or held[0] != pid:
                if sentinel:
                    continue  # another of several first ones, or a range without rows
            sig = signature(text.encode("utf-8", "surrogatepass"))
            if held is not None and held[0] == pid:
                _, mine, own, own_sig = held
                n = len(own)
                m = n // 3
                edited = (own[: n - m] + text[:m]).encode("utf-8", "surrogatepass")
                edited_sig = signature(edited)
                out.append((mine, n, hashlib.sha256(edited).hexdigest(), _hex(own_sig), _hex(edited_sig), likeness(own_sig, edited_sig), likeness(own_sig, sig)))
            held = None if sentinel else (pid, doc_id, text, sig)
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(fields, map(list, zip(*out, strict=True)), strict=True)))


def _bounds(keyed: DataFrame, parts: int) -> tuple[tuple | None, list[tuple]]:
    """(first key, first keys of the other ranges) of about ``parts`` ranges of equally many rows."""
    ranged = keyed.select(*KEY).repartitionByRange(parts, *KEY).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*KEY)).alias("first"))
    firsts = sorted(tuple(r["first"]) for r in ranged.collect())
    return (firsts[0], firsts[1:]) if firsts else (None, [])


#: The order of documents: null ids last, then descending ids, then the texts' hashes.
KEY = ("last", "down", "hash")


def _structs(keys: list[tuple]):
    return F.array(*[F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(KEY, b, ("boolean", "long", "long"), strict=True)]) for b in keys])


def _range_of(bounds: list[tuple]):
    """Number of bounds up to a row's key, by bisection."""
    if not bounds:
        return F.lit(0)
    listed, size, key = _structs(bounds), len(bounds), F.struct(*KEY)
    step = [1 << i for i in reversed(range(size.bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(x) for x in step]), F.lit(0), lambda at, x: F.when((at + x <= size) & (F.element_at(listed, F.least(at + x, F.lit(size))) <= key), at + x).otherwise(at)
    )


def fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of the texts of ``docs`` (doc_id, text) and of their edited texts.

    The edited text has its last third replaced by as much of the next document's beginning.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a null id's place must not depend on ~null
    keyed = texts.withColumns({"last": F.col("doc_id").isNull(), "down": F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")), "hash": F.xxhash64("text")})
    held = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    top, bounds = _bounds(keyed, min(MAX_RANGES, max(2, -(-held // range_bytes))))
    count = len(bounds) + 1

    def place(pid, sentinel: bool):
        return F.struct(pid.cast("int").alias("pid"), F.lit(sentinel).alias("sentinel"))

    ranged, key, places = keyed.withColumn("pid", _range_of(bounds).cast("int")), F.struct(*KEY), [place(F.col("pid"), False)]
    if bounds:  # the first rows of ranges: those whose key is the bound that their range starts with
        starts = (F.col("pid") > 0) & (F.element_at(_structs(bounds), F.greatest(F.col("pid"), F.lit(1))) == key)
        places.append(F.when(starts, place(F.col("pid") - 1, True)))
    if top is not None:
        places.append(F.when(F.element_at(_structs([top]), 1) == key, place(F.lit(count - 1), True)))
    rows = ranged.select("doc_id", "text", *KEY, F.explode(F.array_compact(F.array(*places))).alias("place")).select("place.*", "doc_id", "text", *KEY)
    dealt = rows.repartitionById(count, "pid").sortWithinPartitions("sentinel", *KEY).select("pid", "sentinel", "doc_id", "text")
    return dealt.mapInArrow(
        _stream, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
