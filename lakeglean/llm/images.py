"""Copies of images, cropped or edited, by local descriptors.

Corners are found at several scales, each is given the orientation of its intensity centroid, and
256 comparisons of smoothed pixel pairs, turned to that orientation, make a binary descriptor.
Descriptors are looked up in Hamming tables: each table is a choice of ``width`` of the 256 bits, and
one of them at least is likely to be free of differences, so an equi-join on (table, bits) finds near ones.
Matches vote for a similarity transform (scale and turn, then shift); a pair of images is a copy when
enough matches agree on one.

Images with equal bytes are one class before any join, so thousands of copies meet once.  Keys
grow with the number of points (1.5 times its logarithm in bits), so that chance matches of a query stay as
few in a large table as in a small one.  The number of tables grows with the keys, so that a point with
one bit in ten changed is found as often at any width (``FOUND``, by the binomial law); a copy has
several times the points that the consensus needs.
A slice of the queries meets a block of the images in one task (a cogroup), so both are bounded, and matches that chance
makes, whose number grows with queries times images, never leave it: they are counted by pair of classes, checked for a
transform there, and only links are written.  A task whose matches grow too many halves its block, or its slice.  Keys whose bits are
nearly all equal are not looked up: they are flat patches, and a copy has others (``flat`` = 0 looks up all).

Scales are a quarter apart, so a resized copy has its corners at a scale that is at most an eighth off.
The number of keypoints follows the image's area, so a small crop of a large image keeps its share;
``keypoints`` sets it.

Images are raw grey-scale rasters: two little-endian 16-bit sizes (height, width), then the pixels.
Defined cases: null, unreadable, tiny or flat images have no keypoints and match only equal bytes; repeated
rows are copies; rows of one id with different images are images of their own, answered under that id;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

#: Keypoints of an image of 72 x 72 pixels, and the least of any; larger ones have more by their area.
KEYPOINTS = 64
SCALES = (1.0, 1.25, 1.5625, 1.953125, 2.44140625)
BANDS = 16
CONSENSUS = 5
#: Bits of 256 in which two descriptors may differ, and the share of points found if one in ten does.
NEAR = 44
FOUND = 0.75
#: A key with fewer bits of one kind is that of a flat patch.
FLAT = 3
#: Corners that are described at a time.
CHUNK = 4096
#: Pixels of images of one size that are looked through at a time.
STACK = 1 << 17
#: Points of a slice of the queries and of a block of the images; pairs of points that are looked at together; pairs
#: of near points from which a task halves its block or slice.
SLICE = 1 << 19
BLOCK = 1 << 20
BATCH = 1 << 18
MATCHES = 1 << 22
_RNG = np.random.Generator(np.random.PCG64(9))
#: Each test compares a place with one close by: such tests depend on one another the least.
_PLACES = _RNG.uniform(-7, 7, (256, 2))
_PAIRS = np.clip(np.concatenate([_PLACES, _PLACES + _RNG.normal(0, 2.5, (256, 2))], axis=1), -8, 8)
_REACH = 8


def encode(pixels: np.ndarray) -> bytes:
    return struct.pack("<HH", *pixels.shape) + np.clip(np.rint(pixels), 0, 255).astype(np.uint8).tobytes()


def decode(raw: bytes | None) -> np.ndarray | None:
    if not raw or len(raw) < 4:
        return None
    h, w = struct.unpack("<HH", raw[:4])
    return np.frombuffer(raw, np.uint8, h * w, 4).reshape(h, w).astype(np.float32) if h * w and len(raw) == 4 + h * w else None


def resize(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear."""
    ys, xs = (np.linspace(0, img.shape[i] - 1, n) for i, n in enumerate((h, w)))
    y0, x0 = np.minimum(ys.astype(int), max(0, img.shape[0] - 2)), np.minimum(xs.astype(int), max(0, img.shape[1] - 2))
    y1, x1 = np.minimum(y0 + 1, img.shape[0] - 1), np.minimum(x0 + 1, img.shape[1] - 1)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    top = img[y0][:, x0] * (1 - fx) + img[y0][:, x1] * fx
    low = img[y1][:, x0] * (1 - fx) + img[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def _blur(img: np.ndarray) -> np.ndarray:
    """Over the last two axes."""
    k = np.array([1, 4, 6, 4, 1], np.float32) / 16
    p = np.pad(img, [(0, 0)] * (img.ndim - 2) + [(2, 2)] * 2, mode="edge")
    rows = sum(k[i] * p[..., i : i + img.shape[-2], :] for i in range(5))
    return sum(k[i] * rows[..., i : i + img.shape[-1]] for i in range(5))


_DISC = np.stack([m[np.hypot(*np.mgrid[-_REACH + 1 : _REACH, -_REACH + 1 : _REACH]) < _REACH] for m in np.mgrid[-_REACH + 1 : _REACH, -_REACH + 1 : _REACH]])


def _patches(im: np.ndarray, soft: np.ndarray, of: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orientation and packed tests of the patches around (xs, ys) in the images ``of`` of a stack."""
    (_, h, w), (yy, xx) = im.shape, _DISC
    patch = im[of[:, None], ys[:, None] + yy, xs[:, None] + xx]
    patch = patch - patch.mean(1, keepdims=True)
    my, mx = (patch * yy.astype(np.float32)).sum(1), (patch * xx.astype(np.float32)).sum(1)  # not by BLAS, whose rounding depends on the other patches
    angle = np.arctan2(my, mx)
    # tests look at what is left without the patch's slope, which the orientation tells already
    sx, sy = (mx / (xx * xx).sum())[:, None], (my / (yy * yy).sum())[:, None]
    cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]

    def at(px, py):
        dx, dy = np.rint(px * cos - py * sin).astype(int), np.rint(px * sin + py * cos).astype(int)
        x, y = np.clip(xs[:, None] + dx, 0, w - 1), np.clip(ys[:, None] + dy, 0, h - 1)
        return soft[of[:, None], y, x] - sx * (x - xs[:, None]) - sy * (y - ys[:, None])

    return angle, np.packbits(at(_PAIRS[:, 0], _PAIRS[:, 1]) < at(_PAIRS[:, 2], _PAIRS[:, 3]), axis=1)


def describe(img: np.ndarray | None, keypoints: int = KEYPOINTS) -> list[tuple[float, float, float, float, bytes]]:
    """(x, y, scale, angle, descriptor of 32 bytes) of the strongest corners, in image pixels."""
    ((places, bits),) = describe_all([img], keypoints)
    return [(*p, bytes(b)) for p, b in zip(places.tolist(), bits, strict=True)]


def describe_all(imgs: list[np.ndarray | None], keypoints: int = KEYPOINTS) -> list[tuple[np.ndarray, np.ndarray]]:
    """``describe`` of each image, as places (n, 4) and bits (n, 32); images of one size are described together."""
    out = [(np.zeros((0, 4)), np.zeros((0, 32), np.uint8))] * len(imgs)
    sizes: dict[tuple[int, ...], list[int]] = {}
    for i, img in enumerate(imgs):
        if img is not None and min(img.shape) >= 2 * _REACH + 4:
            sizes.setdefault(img.shape, []).append(i)
    for (h, w), mine in sizes.items():
        step = max(1, STACK // (h * w))
        for lo in range(0, len(mine), step):
            for i, found in zip(mine[lo : lo + step], _describe_stack(np.stack([imgs[i] for i in mine[lo : lo + step]]), keypoints), strict=True):
                out[i] = found
    return out


def _describe_stack(imgs: np.ndarray, keypoints: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and bits of the strongest corners of each image of a stack."""
    n, height, width = imgs.shape
    most = max(keypoints, keypoints * height * width // 72**2)
    levels, found = [], []
    for scale in SCALES:
        h, w = int(height / scale), int(width / scale)
        if min(h, w) < 2 * _REACH + 4:
            break
        im = _blur(imgs if scale == 1 else np.stack([resize(img, h, w) for img in imgs]))
        gy, gx = np.gradient(im, axis=(1, 2))
        a, b, c = _blur(gx * gx), _blur(gy * gy), _blur(gx * gy)
        response = a * b - c * c - 0.05 * (a + b) ** 2
        inner = response[:, _REACH : h - _REACH, _REACH : w - _REACH]
        p = np.pad(inner, [(0, 0), (1, 1), (1, 1)], mode="constant", constant_values=-np.inf)
        peak = inner > 1e-3 * np.maximum(1.0, inner.max(axis=(1, 2), keepdims=True))
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                if (dy, dx) != (1, 1):
                    peak &= inner >= p[:, dy : dy + inner.shape[1], dx : dx + inner.shape[2]]
        of, ys, xs = np.nonzero(peak)
        strength = inner[of, ys, xs]
        best = _strongest(of, np.lexsort((-strength, of)), most)
        of, ys, xs, strength = of[best], ys[best] + _REACH, xs[best] + _REACH, strength[best]
        found.append(np.stack([of, strength, xs * (width / w), ys * (height / h), np.full(len(of), scale), xs, ys, np.full(len(of), len(levels))]).astype(float))
        levels.append(im)
    of, strength, x, y, scale, px, py, level = np.concatenate(found, axis=1)
    best = _strongest(of, np.lexsort((scale, y, x, -strength, of)), most)
    x, y, scale = x[best], y[best], scale[best]
    of, px, py, level = (v[best].astype(int) for v in (of, px, py, level))
    angle, packed = np.zeros(len(best)), np.zeros((len(best), 32), np.uint8)
    for i, im in enumerate(levels):  # only the corners that stay are described
        mine = np.flatnonzero(level == i)
        soft = _blur(im) if len(mine) else im
        for lo in range(0, len(mine), CHUNK):
            here = mine[lo : lo + CHUNK]
            angle[here], packed[here] = _patches(im, soft, of[here], px[here], py[here])
    places, bounds = np.stack([x, y, scale, angle], axis=1), np.searchsorted(of, np.arange(n + 1))
    return [(places[lo:hi], packed[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]


def _strongest(of: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` of each image in an order by image."""
    sorted_of = of[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_of, sorted_of) < most]


def _described(keypoints: int):
    """(id, image) to (id, sha, bits, places): 32 bytes of bits a keypoint, and four floats (x, y, scale, angle)."""
    import hashlib

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                raws = part.column(1).to_pylist()
                shas = [hashlib.sha256(raw or b"").hexdigest() for raw in raws]
                each = dict(zip(shas, raws, strict=True))
                known = {sha: (bits.tobytes(), places.astype("<f4").tobytes()) for sha, (places, bits) in zip(each, describe_all([decode(raw) for raw in each.values()], keypoints), strict=True)}
                bits, places = ([known[sha][k] for sha in shas] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shas), pa.array(bits, pa.binary()), pa.array(places, pa.binary())], names=["id", "sha", "bits", "places"])

    return run


def consensus(ax, ay, a_scale, a_angle, bx, by, b_scale, b_angle, enough: int | None = None) -> int:
    """How many matches agree on one similarity transform: the best of each match's own vote, or of the
    first votes that have one that is ``enough``."""
    # places of one pixel count once: they stand together
    _, pixel = np.unique(np.stack([np.rint(ax), np.rint(ay)]), axis=1, return_inverse=True)
    order = np.argsort(pixel.ravel(), kind="stable")
    starts = np.flatnonzero(np.diff(pixel.ravel()[order], prepend=-1))
    ax, ay, bx, by = (v[order] for v in (ax, ay, bx, by))
    ratio, turn = (b_scale / a_scale)[order], (b_angle - a_angle)[order]
    best = 0
    for lo in range(0, len(ax), 64):
        i = np.arange(lo, min(lo + 64, len(ax)))[:, None]
        s, c, d = ratio[i], np.cos(turn[i]), np.sin(turn[i])
        x = (ax - ax[i]) * c * s - (ay - ay[i]) * d * s + bx[i]
        y = (ax - ax[i]) * d * s + (ay - ay[i]) * c * s + by[i]
        good = (np.hypot(x - bx, y - by) < 4) & (np.abs(np.log(ratio / s)) < 0.6) & (np.abs((turn - turn[i] + np.pi) % (2 * np.pi) - np.pi) < 0.5)
        best = max(best, int(np.logical_or.reduceat(good, starts, axis=1).sum(1).max()))
        if enough and best >= enough:
            break
    return best


def bit_tables(width: int) -> list[np.ndarray]:
    """The bits of each table: as many tables as find ``FOUND`` of points with one bit in ten changed, or ``BANDS``."""
    changed = np.arange(257 - width)
    odds = np.array([comb(256, k) * 0.1**k * 0.9 ** (256 - k) for k in changed.tolist()])
    free = np.array([comb(256 - k, width) / comb(256, width) for k in changed.tolist()])
    low, count = BANDS - 1, BANDS
    while (odds * (1 - free) ** count).sum() > 1 - FOUND:
        low, count = count, 2 * count
    while count - low > 1:
        mid = (low + count) // 2
        low, count = (mid, count) if (odds * (1 - free) ** mid).sum() > 1 - FOUND else (low, mid)
    rng = np.random.Generator(np.random.PCG64([9, width]))
    out: list[np.ndarray] = []
    while len(out) < count:
        order = rng.permutation(256)
        out += [order[i : i + width] for i in range(0, 256 - width + 1, width)]
    return out[:count]


def table_keys(bits: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """(points, tables) keys: the bits that each table chooses of the descriptors (points, 32)."""
    columns = np.ascontiguousarray(bits.T)
    return np.stack([_keys(columns, at) for at in tables], axis=1)


def _keys(columns: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A table's keys of the descriptors (32, points)."""
    out = np.zeros(columns.shape[1], np.int64)
    for i in range(0, len(at), 8):
        byte = np.zeros(columns.shape[1], np.uint8)
        for t in at[i : i + 8].tolist():
            byte = byte << 1 | columns[t >> 3] >> (7 - t % 8) & 1
        out = out << len(at[i : i + 8]) | byte
    return out


def _looked_up(columns: np.ndarray, at: np.ndarray, flat: int) -> tuple[np.ndarray, np.ndarray]:
    """A table's keys, ascending, and their points; without those of flat patches."""
    keys = _keys(columns, at)
    ones = np.bitwise_count(keys)
    rows = np.flatnonzero((ones >= flat) & (ones <= len(at) - flat))  # nearly equal bits: a flat patch, like any other
    order = np.argsort(keys[rows])
    return keys[rows][order], rows[order]


def near_points(a: np.ndarray, b: np.ndarray, a_own: np.ndarray, b_own: np.ndarray, tables: list[np.ndarray], near: int, flat: int, most: int | None = None) -> np.ndarray | None:
    """Pairs i * len(b) + j, ascending, of points a[i] and b[j] (descriptors) of different owners that differ in
    fewer than ``near`` bits and have a key in common; None if more than ``most`` of them turn up."""
    a_columns, b_columns = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    a_words, b_words = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    out, fresh, held = np.zeros(0, np.int64), [], 0
    for at in tables:
        (a_keys, a_rows), (b_keys, b_rows) = _looked_up(a_columns, at, flat), _looked_up(b_columns, at, flat)
        low = np.searchsorted(a_keys, b_keys, "left")
        count = np.searchsorted(a_keys, b_keys, "right") - low
        hit = np.flatnonzero(count)
        low, count, b_rows = low[hit], count[hit], b_rows[hit]
        ends = np.cumsum(count)
        for lo in range(0, int(ends[-1]) if len(ends) else 0, BATCH):
            n = np.arange(lo, min(lo + BATCH, int(ends[-1])))
            k = np.searchsorted(ends, n, "right")
            i, j = a_rows[low[k] + n - (ends[k] - count[k])], b_rows[k]
            other = a_own[i] != b_own[j]
            i, j = i[other], j[other]
            differ = np.bitwise_count(a_words[i] ^ b_words[j])
            close = differ[:, 0].astype(np.int16) + differ[:, 1] + differ[:, 2] + differ[:, 3] < near
            fresh.append(i[close] * len(b) + j[close])
            held += len(fresh[-1])
            if held > max(len(out), min(BATCH, most or BATCH)):
                out, fresh, held = np.unique(np.concatenate([out, *fresh])), [], 0
                if most and len(out) > most:
                    return None
    return np.unique(np.concatenate([out, *fresh]))


class _Points(NamedTuple):
    """Images of a task: classes, where each one's points begin and end, descriptors and places of all points."""

    classes: np.ndarray
    bounds: np.ndarray
    bits: np.ndarray
    places: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> _Points:
        bits, places = table["bits"].to_pylist(), table["places"].to_pylist()
        bounds = np.cumsum([0, *(len(b) // 32 for b in bits)])
        return _Points(table["class"].to_numpy(), bounds, np.frombuffer(b"".join(bits), np.uint8).reshape(-1, 32), np.frombuffer(b"".join(places), "<f4").reshape(-1, 4))

    def halves(self) -> list[_Points]:
        n = len(self.classes)
        parts = [(lo, hi, slice(self.bounds[lo], self.bounds[hi])) for lo, hi in ((0, n // 2), (n // 2, n))]
        return [_Points(self.classes[lo:hi], self.bounds[lo : hi + 1] - self.bounds[lo], self.bits[at], self.places[at]) for lo, hi, at in parts]

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.classes)), np.diff(self.bounds))


def _links(a: _Points, b: _Points, tables: list[np.ndarray], needed: int, near: int, flat: int, most: int):
    """(class, class) of images of ``a`` and ``b`` whose matches have a consensus."""
    a_own, b_own = a.owners(), b.owners()
    found = near_points(a.bits, b.bits, a.classes[a_own], b.classes[b_own], tables, near, flat, most if max(len(a.classes), len(b.classes)) > 1 else None)
    if found is None:
        for x, y in [(a, y) for y in b.halves()] if len(b.classes) > 1 else [(x, b) for x in a.halves()]:
            yield from _links(x, y, tables, needed, near, flat, most)
        return
    i, j = np.divmod(found, max(1, len(b.bits)))
    pair = a_own[i] * len(b.classes) + b_own[j]
    order = np.argsort(pair, kind="stable")
    i, j, pair = i[order], j[order], pair[order]
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    if not len(starts):
        return
    points = np.add.reduceat((np.diff(pair, prepend=-1) != 0) | (np.diff(i, prepend=-1) != 0), starts, dtype=int)
    for lo, hi in zip(starts[points >= needed].tolist(), np.append(starts[1:], len(pair))[points >= needed].tolist(), strict=True):
        if consensus(*a.places[i[lo:hi]].T.astype(float), *b.places[j[lo:hi]].T.astype(float), enough=needed) >= needed:
            yield a.classes[a_own[i[lo]]], b.classes[b_own[j[lo]]]


def _linked(tables: list[np.ndarray], needed: int, near: int, flat: int, most: int):
    """A slice of the queries and a block of the images to links (a, b)."""

    def run(left, right):
        found = list(_links(_Points.of(left), _Points.of(right), tables, needed, near, flat, most)) if left.num_rows and right.num_rows else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def copies(images: DataFrame, query: str = "id % 20 = 0", needed: int = CONSENSUS, width: int | None = None, keypoints: int = KEYPOINTS, near: int = NEAR, flat: int = FLAT) -> DataFrame:
    """(id, class_id, n_points, is_query, matches): for each image its class of equal bytes, and for
    the queries the classes found (smallest id of each), ascending."""
    spark = images.sparkSession
    scratch = Scratch(spark, "images")
    rows = images.select(F.col("id").cast("long").alias("id"), F.col("image").cast("binary").alias("image"))
    described = scratch.cut(rows.mapInArrow(_described(keypoints), "id long, sha string, bits binary, places binary"), "described")
    asked = F.coalesce(F.expr(query), F.lit(False))
    first = F.min_by(F.struct("bits", "places"), F.coalesce("id", F.lit(-1).cast("long")))
    members = scratch.cut(described.select("id", "sha", F.floor(F.length("bits") / 32).cast("int").alias("n_points")), "members")
    classes = described.groupBy("sha").agg(F.min("id").alias("first_id"), F.max(asked).alias("asked"), first.alias("points")).where("first_id IS NOT NULL")
    # a class is known by its hash: rows of one id may have different images
    classes = scratch.cut(classes.select(F.xxhash64("sha").alias("class"), "sha", F.col("first_id"), "asked", "points.bits", "points.places"), "classes")
    scratch.drop("described")
    some = classes.select("asked", (F.length("bits") / 32).cast("long").alias("n")).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("asked"), F.col("n"))).alias("asked")).first()
    n, n_asked = some["all"] or 0, some["asked"] or 0
    # chance matches of a key stay few however many points there are
    width = width or min(40, max(16, int(np.ceil(1.5 * np.log2(max(2, n)))) - 1))
    slices = max(1, -(-n_asked // SLICE))
    blocks = max(-(-n // BLOCK), min(24, -(-n // (1 << 14))), 1)
    point = classes.where("length(bits) > 0").select("class", "asked", "bits", "places")
    place = F.xxhash64("class", F.lit(9))  # other than the hash that Spark deals rows by
    left = point.where("asked").select("class", "bits", "places", F.pmod(place, F.lit(slices)).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = point.select("class", "bits", "places", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.pmod(place, F.lit(blocks)).cast("int").alias("block"))
    linked = left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInArrow(_linked(bit_tables(width), needed, near, flat, MATCHES), "a long, b long")
    links = scratch.cut(linked, "links")
    firsts = classes.select(F.col("class").alias("b"), "first_id")
    found = links.join(firsts, "b").groupBy("a").agg(F.array_sort(F.collect_set("first_id")).alias("matches"))
    out = members.join(classes.select("sha", "class", F.col("first_id").alias("class_id")), "sha", "left")
    out = out.join(found, F.col("class") == F.col("a"), "left")
    return out.select("id", F.coalesce("class_id", "id").alias("class_id"), "n_points", asked.alias("is_query"), F.when(asked, F.coalesce("matches", F.array().cast("array<long>"))).alias("matches"))


def drawn(vectors: DataFrame, side: int = 72) -> DataFrame:
    """(id, image): each vector drawn as a picture, so that a table without media has some.

    Equal vectors give equal pictures.  Every tenth id's picture comes a second time, edited (see
    ``edited``), under the id ``-10 - id``, so half of these edits are queries and half are to be found by one.  The
    edits of ids 100, 300, 500, ... are all of the smallest id's picture: a large group of near copies.
    """
    one = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("v"))
    first = one.orderBy("id", "v").limit(1).collect()
    common = first[0]["v"] if first else None

    def pixels(v):
        return picture(np.array([x or 0.0 for x in v or []], np.float64), side)

    def run(batches):
        for batch in batches:
            ids, images = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                img = pixels(v)
                ids.append(i)
                images.append(encode(img))
                if i is not None and i >= 0 and i % 10 == 0 and v:
                    ids.append(-10 - i)
                    images.append(encode(edited(pixels(common) if i % 200 == 100 else img, i // 10)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], names=["id", "image"])

    return vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("v")).mapInArrow(run, "id long, image binary")


EDITS = 7


def edited(img: np.ndarray, seed: int) -> np.ndarray:
    """An image cropped (by an eighth, or to half its area), resized (0.75 or 1.25), dimmed, noisy or
    turned, by ``seed``."""
    rng, kind = np.random.Generator(np.random.PCG64(seed)), seed // 2 % EDITS
    if kind < 2:
        h, w = (round(n * (0.875, 0.71)[kind]) for n in img.shape)
        y, x = (int(rng.integers(0, n - m + 1)) for n, m in zip(img.shape, (h, w), strict=True))
        return img[y : y + h, x : x + w]
    if kind < 4:
        return resize(img, *(round(n * (0.75, 1.25)[kind - 2]) for n in img.shape))
    if kind == 4:
        return img * rng.uniform(0.7, 0.9) + rng.uniform(5, 25)
    if kind == 5:
        return img + rng.normal(0, 8, img.shape)
    return np.rot90(img, int(rng.integers(1, 4)))


def picture(v: np.ndarray, side: int = 72) -> np.ndarray:
    """Waves and discs whose places, directions and shades are the vector's values."""
    at = np.arange(side) / side
    v = np.nan_to_num(v) * 97  # so that only equal vectors give like pictures
    a, b, c, d = v[: len(v) // 4 * 4].reshape(-1, 4).T[:, :, None]
    fx, fy = (a - np.floor(a)) * 16 - 8, (b - np.floor(b)) * 16 - 8
    across, down = 2 * np.pi * (fx * at + d), 2 * np.pi * fy * at
    shade = 0.4 + c - np.floor(c)
    img = np.cos(down).T @ (shade * np.cos(across)) - np.sin(down).T @ (shade * np.sin(across))
    x, y, r = c * 3 - np.floor(c * 3), d * 3 - np.floor(d * 3), 0.05 + (a * 3 - np.floor(a * 3)) * 0.1
    disc = ((at - x) ** 2)[:, None, :] + ((at - y) ** 2)[:, :, None] < (r * r)[:, :, None]
    img += np.tensordot(3 * np.sign(b[:, 0]), disc, 1)
    spread = img.std()
    return np.clip(128 + 45 * img / spread, 0, 255) if spread > 0 else np.full((side, side), 128.0)


def op9_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(drawn(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
