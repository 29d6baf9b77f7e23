"""Separator-normalised text: the words of Arrow text columns, lower-cased (A-Z) and joined by single spaces.

Everything is computed on the UTF-8 buffer of a batch in slices of bounded
size.  A slice ends between words and begins with the last ``back`` words of
the one before, so that every run of ``back + 1`` words lies in one slice and
a very long text needs no more memory than a slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from corpusloom.llm.tokens import LOWER, buffers

SLICE = 1 << 20  # bytes; the arrays of a slice take about 50 times as much


def byte_class(*ranges: tuple[int, int] | int) -> np.ndarray:
    """Membership of each byte; a range includes both ends."""
    out = np.zeros(256, bool)
    for r in ranges:
        a, b = (r, r) if isinstance(r, int) else r
        out[a:b + 1] = True
    return out


@dataclass
class Slice:
    data: np.ndarray    # words, a space after each
    start: np.ndarray   # first byte of each word in ``data``
    end: np.ndarray     # byte after the last
    row: np.ndarray     # row of each word
    piece: np.ndarray   # equal for two neighbours of one row when nothing that ends a piece lies between them
    carried: int        # words at the front that the slice before had too

    def first_words(self, n: int) -> np.ndarray:
        """Indices of the first word of all runs of ``n`` words inside one piece that end in a new word."""
        total = len(self.start) - n + 1
        if total <= 0:
            return np.zeros(0, np.int64)
        ok = (self.row[:total] == self.row[n - 1:]) & (self.piece[:total] == self.piece[n - 1:])
        ok[:max(0, self.carried - n + 1)] = False
        return np.flatnonzero(ok)


def _cut_after(data: np.ndarray, offsets: np.ndarray, word: np.ndarray, at: int) -> int:
    """The first place from ``at`` on that is not inside a word."""
    n = len(data)
    if at >= n:
        return n
    row_end = int(offsets[np.searchsorted(offsets, at)])
    while at < row_end:
        gap = np.flatnonzero(~word[data[at:min(row_end, at + SLICE)]])
        if len(gap):
            return at + int(gap[0])
        at = min(row_end, at + SLICE)
    return row_end


def slices(col: pa.Array | pa.ChunkedArray, word: np.ndarray, ends: np.ndarray | None = None, back: int = 0) -> Iterator[Slice]:
    """The words of a text column, slice by slice; null is empty.

    ``word`` marks the bytes of words (bytes above 0x7F belong to one class, so
    characters are never cut), ``ends`` the separators that end a piece.
    """
    data, offsets = buffers(col)
    row_starts = np.unique(offsets[:-1][np.diff(offsets) > 0])
    begin = fresh = 0
    while fresh < len(data):
        stop = _cut_after(data, offsets, word, fresh + SLICE)
        part = data[begin:stop]
        inside = word[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[0] = edge[-1] = True
        edge[row_starts[np.searchsorted(row_starts, begin):np.searchsorted(row_starts, stop)] - begin] = True
        gap = ~inside
        first = inside & edge[:-1]
        first[1:] |= inside[1:] & gap[:-1]
        last = inside & edge[1:]
        last[:-1] |= inside[:-1] & gap[1:]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        size = e - s
        start = np.cumsum(size + 1) - size - 1
        out = np.full(int((size + 1).sum()), 0x20, np.uint8)
        out[np.arange(int(size.sum())) + np.repeat(np.arange(len(s)), size)] = LOWER[part[inside]]
        row = np.searchsorted(offsets, begin + s, "right") - 1
        piece = np.zeros(len(s), np.int32) if ends is None else np.cumsum(ends[part], dtype=np.int32)[s]
        yield Slice(out, start, start + size, row, piece, int(np.searchsorted(s, fresh - begin)))
        fresh = stop
        begin = int(begin + s[-back]) if back and len(s) >= back else stop if not back or not len(s) else int(begin + s[0])
