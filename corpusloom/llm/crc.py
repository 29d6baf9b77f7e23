"""CRC-32 of any substring from the running CRCs of its text.

A CRC without the usual initial and final complement is linear over GF(2): the
CRC of a text is that of its prefix, moved on by as many zero bytes as follow,
plus (xor) that of the rest.  So the CRC of ``data[a:b]`` is the running CRC at
``b`` plus the running CRC at ``a`` moved on by ``b - a`` bytes.
"""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, reflected
WIDTH = 512
ONES = np.uint32(0xFFFFFFFF)
_BYTE, _EIGHT = np.uint32(255), np.uint32(8)


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return t


TABLE = _byte_table()


def _zero_byte(c: np.ndarray) -> np.ndarray:
    return TABLE[c & _BYTE] ^ (c >> _EIGHT)


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The linear map whose values of each byte at each place are ``tables[place, byte]``."""
    out = tables[0][c & _BYTE]
    for k in range(1, 4):
        out = out ^ tables[k][(c >> np.uint32(8 * k)) & _BYTE]
    return out


def _short_moves() -> np.ndarray:
    out = np.empty((WIDTH + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (_EIGHT * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(WIDTH):
        out[n + 1] = _zero_byte(out[n])
    return out


MOVES = _short_moves()  # by 0 to WIDTH zero bytes


def _long_moves() -> list[np.ndarray]:
    out = [MOVES[WIDTH]]
    for _ in range(40):
        out.append(_apply(out[-1], out[-1]))
    return out


LONG = _long_moves()  # by WIDTH * 2**j zero bytes


def moved(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs moved on by ``n`` zero bytes each."""
    rest, far = n % WIDTH, n // WIDTH
    out = MOVES[rest, 0, c & _BYTE]
    for k in range(1, 4):
        out = out ^ MOVES[rest, k, (c >> np.uint32(8 * k)) & _BYTE]
    j = 0
    while (far >> j).any():
        at = np.flatnonzero((far >> j) & 1)
        out[at] = _apply(LONG[j], out[at])
        j += 1
    return out


class RunningCrc:
    """Running CRCs of ``data`` after every byte, from one scan.

    The scan runs down all rows of a table of ``WIDTH`` columns at once; the
    value before a row is carried over by doubling.
    """

    def __init__(self, data: np.ndarray):
        rows = max(1, -(-len(data) // WIDTH))
        table = np.zeros(rows * WIDTH, np.uint8)
        table[:len(data)] = data
        columns = np.ascontiguousarray(table.reshape(rows, WIDTH).T)
        self.inside = np.empty((WIDTH, rows), np.uint32)
        c = np.zeros(rows, np.uint32)
        for j in range(WIDTH):
            c = TABLE[(c ^ columns[j]) & _BYTE] ^ (c >> _EIGHT)
            self.inside[j] = c
        step, j = 1, 0
        while step < rows:
            c[step:] ^= _apply(LONG[j], c[:-step].copy())
            step, j = step * 2, j + 1
        self.before = np.concatenate([np.zeros(1, np.uint32), c[:-1]])

    def at(self, length: np.ndarray) -> np.ndarray:
        """Running CRC of the first ``length`` bytes."""
        row, col = np.divmod(np.maximum(length - 1, 0), WIDTH)
        out = self.inside[col, row] ^ moved(self.before[row], col + 1)
        return np.where(length > 0, out, np.uint32(0))

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The usual CRC-32 of each ``data[start:end]``."""
        n = end - start
        raw = self.at(end) ^ moved(self.at(start), n)
        return raw ^ moved(np.full(len(n), ONES), n) ^ ONES
