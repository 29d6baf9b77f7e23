"""Words of Arrow text columns as NumPy arrays: hashes, byte spans and row bounds.

A word is a run of bytes outside U+0020 and U+0009 to U+000D.  Everything is
computed on the UTF-8 buffer of a whole batch, in slices of bounded size that
end between words, so a very long text needs a few bytes of memory per byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 4 << 20
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scramble of 64-bit numbers."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE | np.uint64(1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    hash: np.ndarray    # uint64 per word
    start: np.ndarray   # first byte in ``data``
    end: np.ndarray     # byte after the last
    bounds: np.ndarray  # words of row i are bounds[i]:bounds[i + 1]
    data: np.ndarray    # bytes of all rows
    offsets: np.ndarray  # bytes of row i are offsets[i]:offsets[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of disjoint, ascending, non-empty spans of ``data``."""
    if not len(start):
        return np.zeros(0, np.uint64)
    lens = end - start
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    values = BYTE_CODES[data[pos + np.repeat(start, lens)]] * powers(int(lens.max()))[pos]
    return mix(np.add.reduceat(values, first) ^ (lens.astype(np.uint64) * _M2))


def _slices(separator: np.ndarray) -> list[int]:
    cuts, n = [0], len(separator)
    while n - cuts[-1] > SLICE:
        at = cuts[-1] + SLICE
        while at < n and not (found := separator[at:at + SLICE]).any():
            at += SLICE
        cuts.append(min(n, at + int(found.argmax())) if at < n else n)
    return [*cuts, n] if cuts[-1] < n else cuts


def words(col: pa.Array | pa.ChunkedArray, lower: bool = True) -> Words:
    """All words of a text column.  ``lower`` folds A-Z only."""
    data, offsets = buffers(col)
    rows = offsets[:-1][np.diff(offsets) > 0]
    hashes, starts, ends = [], [], []
    separator = SEPARATOR[data]
    row_start = np.zeros(len(data) + 1, bool)
    row_start[rows] = True
    row_start[-1:] = True
    cuts = _slices(separator)
    for a, b in zip(cuts, cuts[1:]):
        inside = ~separator[a:b]
        before = np.concatenate([[True], separator[a:b - 1]]) | row_start[a:b]
        after = np.concatenate([separator[a + 1:b], [True]]) | row_start[a + 1:b + 1]
        s, e = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
        part = LOWER[data[a:b]] if lower else data[a:b]
        hashes.append(span_hashes(part, s, e))
        starts.append(s + a)
        ends.append(e + a)
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    start = cat(starts, np.int64)
    return Words(cat(hashes, np.uint64), start, cat(ends, np.int64), np.searchsorted(start, offsets), data, offsets)


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``n`` words in a row of one text, and the index of their first word."""
    total = len(w.hash)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = np.repeat(w.bounds[1:], w.counts) - np.arange(total)
    first = np.flatnonzero(left >= n)
    out = np.zeros(len(first), np.uint64)
    for j, p in enumerate(powers(n)):
        out += w.hash[first + j] * p
    return mix(out ^ np.uint64(n)), first


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and row numbers of all ``n``-word windows; a shorter text is one shingle."""
    h, first = windows(w, n)
    row = w.row[first] if len(first) else np.zeros(0, np.int64)
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    extra = np.zeros(len(short), np.uint64)
    for j in range(n - 1):
        ok = w.counts[short] > j
        at = w.bounds[:-1][short][ok] + j
        extra[ok] = extra[ok] * _BASE + w.hash[at]
    if len(short):
        h, row = np.concatenate([h, mix(extra ^ np.uint64(n))]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, row


def weighted(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(row, hash)`` with their counts, ordered by row and hash."""
    if not len(h):
        return h, row, np.zeros(0, np.int64)
    order = np.argsort(h)
    narrow = np.uint16 if row[-1] < 1 << 16 else np.int64  # 16-bit keys get a radix sort
    order = order[np.argsort(row[order].astype(narrow), kind="stable")]
    h, row = h[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
    return h[new], row[new], np.diff(np.append(new, len(h)))
