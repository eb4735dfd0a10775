"""Vectorised word and shingle hashing over the raw UTF-8 buffers of Arrow string columns.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r; A-Z count as a-z.  No
Python string is made: bytes are looked up in a table of random 64-bit numbers, words are
polynomials over that table, and shingles are polynomials over words, all modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time; bounds a worker's memory at about 60 times this.
BLOCK = 1 << 19
_M = np.uint64


def _table() -> np.ndarray:
    t = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.int64).view(np.uint64) | _M(1)
    t[ord("A") : ord("Z") + 1] = t[ord("a") : ord("z") + 1]
    t[[9, 10, 11, 12, 13, 32]] = 0
    return t


BYTE = _table()
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n."""
    size = max(BLOCK, 1 << (n - 1).bit_length()) if n else BLOCK
    if size not in _POW:
        inverse = pow(_P, -1, 2**64)
        up, down = np.full(size, _P, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _POW.clear()
        _POW[size] = np.cumprod(up), np.cumprod(down)
    up, down = _POW[size]
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: neighbours in, noise out."""
    h = h ^ (h >> _M(33))
    h = h * _M(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _M(33))
    h = h * _M(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _M(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column (null: empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes come to about ``size``."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words before each row and in all) of some rows."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = data[lo:hi]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = (offsets - lo)[:-1]
    at = at[at < len(raw)]
    first[at] |= word[at]
    starts = np.flatnonzero(first)
    before = np.searchsorted(starts, offsets - lo)
    if not len(starts):
        return np.zeros(0, np.uint64), before
    up, down = _powers(len(raw))
    h = np.add.reduceat(BYTE[raw] * up, starts) * down[starts]
    return mix(h), before


def shingle_hashes(words: np.ndarray, before: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle, number of shingles before each row and in all).

    A row with fewer than ``width`` words, but some, has its whole sequence as one shingle.
    """
    counts = np.diff(before)
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    n = len(words)
    full = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width if len(full) else 0):
        full += words[k : n - width + 1 + k] * _M(pow(_Q, k, 2**64))
    long_rows = counts >= width
    if long_rows.all():
        take = None
    else:
        take = long_rows
    result = np.zeros(int(out[-1]), np.uint64)
    rows = np.flatnonzero(take) if take is not None else np.arange(len(counts))
    if len(rows):
        lens = sizes[rows]
        within = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        result[within + np.repeat(out[rows], lens)] = full[within + np.repeat(before[rows], lens)]
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        h = _M(int(counts[r]))
        for k, w in enumerate(words[before[r] : before[r + 1]]):
            h = _M((int(h) + int(w) * pow(_Q, k + 1, 2**64)) % 2**64)
        result[out[r]] = h
    return mix(result), out
