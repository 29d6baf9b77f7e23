"""Small brute-force references for tests (NumPy only)."""

import numpy as np


def cosine_matrix(m):
    u = m / np.linalg.norm(m, axis=1)[:, None]
    return np.maximum(1 - u @ u.T, 0)


def agglomerate(dist, cut, linkage, stop_at=1):
    """Merge the closest pair of clusters until the closest is farther than the cut or few enough are left."""
    groups = {i: [i] for i in range(len(dist))}
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    while True:
        i, j = divmod(int(np.argmin(d)), len(d))
        if not d[i, j] <= cut or len(groups) <= stop_at:
            return {frozenset(g) for g in groups.values()}
        if linkage == "single":
            row = np.minimum(d[i], d[j])
        elif linkage == "complete":
            row = np.maximum(d[i], d[j])
        else:
            ni, nj = len(groups[i]), len(groups[j])
            row = (ni * d[i] + nj * d[j]) / (ni + nj)
        row[i] = row[j] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        groups[i] += groups.pop(j)
