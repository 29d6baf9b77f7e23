"""Scores and distances of blocks of vectors, and the bounds that balls around a pivot give."""

from __future__ import annotations

import numpy as np

SIMILARITIES = ("cosine", "inner_product")
DISTANCES = ("cosine_distance", "L1", "L2", "Linf")
DIGITS = 6
SLACK = 10.0 ** -DIGITS  # rounding may lift a score by half of this
TILE = 256
CANCELS = 0.01  # of both squared lengths: below it, a squared distance is not taken from a product


def unit(m: np.ndarray) -> np.ndarray:
    lengths = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(lengths == 0, 1.0, lengths)[:, None]


def scores(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Query-by-corpus scores, larger is better (distances are negated)."""
    if metric == "inner_product":
        return q @ c.T
    if metric in ("cosine", "cosine_distance"):
        cos = unit(q) @ unit(c).T
        return cos if metric == "cosine" else cos - 1.0
    if metric not in DISTANCES:
        raise ValueError(f"unsupported metric {metric!r}; supported: {SIMILARITIES + DISTANCES}")
    if not len(q) or not len(c):
        return np.empty((len(q), len(c)))
    if metric == "L2":
        return -_euclidean(q, c)
    norm = {"L1": 1, "Linf": np.inf}[metric]
    if len(c) < len(q):
        return np.stack([-np.linalg.norm(q - row, ord=norm, axis=1) for row in c], axis=1)
    return np.stack([-np.linalg.norm(c - row, ord=norm, axis=1) for row in q])


def _euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By one matrix product; pairs that are near for their lengths, where digits would cancel, by their differences."""
    lengths = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :]
    square = lengths - 2.0 * (a @ b.T)
    near = ~(square > CANCELS * lengths)
    out = np.sqrt(np.maximum(square, 0.0))
    if len(b) < len(a):
        for j in np.flatnonzero(near.any(axis=0)):
            out[near[:, j], j] = np.linalg.norm(a[near[:, j]] - b[j], axis=1)
    else:
        for i in np.flatnonzero(near.any(axis=1)):
            out[i, near[i]] = np.linalg.norm(b[near[i]] - a[i], axis=1)
    return out


def gap(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances that obey the triangle inequality: the angle for cosine, L2 for inner products."""
    if metric in ("cosine", "cosine_distance"):
        return np.arccos(np.clip(unit(a) @ unit(b).T, -1.0, 1.0))
    if metric == "inner_product":
        square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)
        return np.sqrt(np.maximum(square, 0.0))
    return -scores(a, b, metric)


def distance(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    return np.maximum(-scores(a, b, "cosine_distance" if metric == "cosine" else metric), 0.0)


def best_scores(q: np.ndarray, pivots: np.ndarray, to_pivot: np.ndarray, low: np.ndarray, high: np.ndarray, metric: str) -> np.ndarray:
    """Upper bound, per query and ball, of the score of a member.

    Members of ball j lie between ``low[j]`` and ``high[j]`` from pivot j;
    ``to_pivot`` has the gaps of the queries.
    """
    if metric == "inner_product":
        return q @ pivots.T + np.sqrt(np.einsum("ij,ij->i", q, q))[:, None] * high[None, :] + 1e-9
    nearest = np.maximum(0.0, np.maximum(to_pivot - high[None, :], low[None, :] - to_pivot) - 1e-9)
    if metric in ("cosine", "cosine_distance"):
        cos = np.cos(np.minimum(nearest, np.pi))
        return cos if metric == "cosine" else cos - 1.0
    return -nearest
