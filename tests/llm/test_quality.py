"""The quadratic discriminant against a plain one, on all kinds of partitionings and constant statistics."""

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import quality

P = len(quality.STATISTICS)


def tasks_sums(x, y, parts, centre):
    """What the tasks of one partitioning send, added up in the order of ``parts``."""
    total = None
    for part in parts:
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * P, pa.int32()), pa.array(x[part].reshape(-1)))
        batch = pa.RecordBatch.from_arrays([values, pa.array(y[part], pa.int32())], ["x", "quality"])
        got = next(quality._sums(centre)(iter([batch]))).column(1).to_numpy()
        total = got if total is None else total + got
    return total.reshape(2, -1)


def fitted(x, y, parts):
    first = tasks_sums(x, y, parts, None)
    n, sums = first[:, 0], first[:, 1:]
    centre = sums.sum(0) / n.sum()
    products = tasks_sums(x, y, parts, centre).reshape(2, P, P)
    return quality.discriminant(n, sums - n[:, None] * centre, products, centre)


def plain(x, y, at):
    """The same rule written with NumPy's own means and covariances."""
    centre, var = x.mean(0), x.var(0)
    varies = var > quality.LEAST_VARIANCE * (1 + centre ** 2)
    z, q = (np.where(varies, (m - centre) / np.sqrt(np.where(varies, var, 1)), m - centre) for m in (x, at))
    z = np.where(varies, z, 0)
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).mean() * own[k] for k in (0, 1))
    log = []
    for k in (0, 1):
        s = (1 - quality.TO_POOLED) * own[k] + quality.TO_POOLED * pooled
        s = (1 - quality.TO_IDENTITY) * s + quality.TO_IDENTITY * max(np.trace(s) / P, 1e-6) * np.eye(P)
        d = q - z[y == k].mean(0)
        log.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,ij->i", d, np.linalg.solve(s, d.T).T))
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def sample(kind):
    rng = np.random.default_rng(11)
    y = np.arange(300) % 2
    x = rng.normal(size=(300, P)) @ rng.normal(size=(P, P)) + y[:, None] * 0.3 - 6.9
    if kind in ("constant", "all constant"):
        x[:, :8 if kind == "constant" else P] = -6.907755278982137
    if kind == "constant in one class":
        x[y == 0, :8] = -6.907755278982137
    if kind == "constant in both classes":
        x[:, :8] = np.where(y, 0.1, -6.907755278982137)[:, None]
    return x, y


@pytest.mark.parametrize("kind", ["varied", "constant", "constant in one class", "constant in both classes", "all constant"])
def test_discriminant_on_any_partitioning(kind):
    x, y = sample(kind)
    rng = np.random.default_rng(3)
    want = plain(x, y, x)
    for _ in range(50):
        order = rng.permutation(300)
        parts = np.split(order, np.sort(rng.choice(np.arange(1, 300), rng.integers(1, 40), replace=False)))
        got = fitted(x, y, parts).score(x)
        assert np.isfinite(got).all() and np.allclose(got, want, atol=1e-6)


def test_constant_statistic_seen_otherwise_later():
    x, y = sample("constant")
    other = x[:5].copy()
    other[:, 0] = 3.0
    score = fitted(x, y, [np.arange(300)]).score(other)
    assert np.isfinite(score).all() and ((score >= 0) & (score <= 1)).all()
