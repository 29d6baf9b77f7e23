"""Document quality by regularised quadratic discriminant analysis.

Every text becomes a vector of transformed statistics.  Counts, sums and
products of the labelled training vectors are added up with Spark; each
class's covariance is shrunk to the pooled one and to a multiple of the
identity.  The score is the posterior of label 1: a difference of log
densities from Mahalanobis distances, with the inverse Cholesky factors of
both classes computed once and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import tokens as tk
from corpusloom.llm.common import cut, freed_shuffles
from corpusloom.llm.perplexity import rule_counts

TO_POOLED, TO_IDENTITY = 0.2, 0.02  # shares of the pooled covariance and of the scaled identity
LEAST_VARIANCE = 1e-9  # of a statistic that is not constant, relative to its square
THRESHOLD = 0.7
_MARKS = b"!|*$%&#<>.,?:;"
STATISTICS = ("words", "word_length", "capitals", "digits", "marks", "other_letters", "bangs", "bars", "stars", "stops", "commas",
              "repeated_lines", "repeated_words", "distinct_words", "top_word", "stutters", "line_words", "marked_words", "hyphens")


def _groups(row: np.ndarray, rows: int, value=None) -> np.ndarray:
    return np.bincount(row, value, rows).astype(float)


def statistics(col: pa.Array) -> np.ndarray:
    """``rows x len(STATISTICS)`` finite numbers; shares are on a log scale, so zero differs from a little."""
    w = tk.words(col)
    rows = len(w.bounds) - 1
    row, n = w.row, np.maximum(w.counts, 1)
    c = rule_counts(col)
    size = np.diff(w.offsets)
    total = np.maximum(size, 1)
    at = np.repeat(np.arange(rows), size)
    of = lambda mask: _groups(at[mask], rows)
    d = w.data
    letters = np.maximum(of(((d | 32) >= 97) & ((d | 32) <= 122)), 1)
    first = d[w.end - 1] if len(w.end) else d
    marked = np.isin(first, np.frombuffer(b"!*$%&#|<>", np.uint8))
    h, of_row, count = tk.weighted(w.hash, row)
    top = np.zeros(rows)
    np.maximum.at(top, of_row, count)
    same = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])
    share = lambda x, y: np.log(x / y + 1e-3)
    lines = of(d == 10) + 1
    byte = lambda *cs: of(np.isin(d, np.frombuffer(b"".join(cs), np.uint8)))
    return np.stack([
        np.log1p(w.counts), np.log1p(c["word_chars"] / n), share(of((d >= 65) & (d <= 90)), letters), share(of((d >= 48) & (d <= 57)), total),
        share(byte(_MARKS), total), share(of(d >= 128), total), share(byte(b"!"), n), share(byte(b"|"), n), share(c["n_symbols"], n),
        share(byte(b"."), n), share(byte(b","), n), share(c["n_dup_lines"], lines), share(c["n_repeat_words"], n),
        share(_groups(of_row, rows), n), share(top, n), share(_groups(row[1:][same], rows), n), np.log1p(w.counts / lines),
        share(_groups(row[marked], rows), n), share(byte(b"-"), n)], 1)


@dataclass
class Model:
    """``factor`` and ``mean`` per class, in standardised statistics; without two usable classes a constant score."""

    centre: np.ndarray
    scale: np.ndarray
    mean: np.ndarray
    factor: np.ndarray  # inverse Cholesky factors
    offset: np.ndarray  # log prior minus log determinant
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        x = (x - self.centre) / self.scale
        density = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, o in zip(self.mean, self.factor, self.offset)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def discriminant(n: np.ndarray, sums: np.ndarray, products: np.ndarray, centre: np.ndarray | None = None) -> Model:
    """Model from numbers, sums and sums of outer products per class (0, 1), both taken about ``centre``.

    The nearer the centre is to the mean of all rows, the less is lost to
    rounding.  A statistic that hardly varies is constant: it has scale 1 and no
    covariance, so the shrinkage alone gives it a variance.
    """
    p = sums.shape[1]
    one, zero = np.ones(p), np.zeros(p)
    if (n < 2).any():
        return Model(zero, one, zero, zero, zero, float(n[1] / n.sum()) if n.sum() else 0.5)
    about = zero if centre is None else centre
    middle = sums.sum(0) / n.sum()
    variance = products.sum(0).diagonal() / n.sum() - middle ** 2
    varies = variance > LEAST_VARIANCE * (1 + (about + middle) ** 2)
    scale = np.sqrt(np.where(varies, variance, 1.0))
    mean = np.where(varies, (sums / n[:, None] - middle) / scale, 0.0)
    raw = [products[k] / n[k] - np.outer(sums[k], sums[k]) / n[k] ** 2 for k in (0, 1)]
    own = [np.where(np.outer(varies, varies), r / np.outer(scale, scale), 0.0) for r in raw]
    centre = about + middle
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    factor, offset = [], []
    for k in (0, 1):
        s = (1 - TO_POOLED) * own[k] + TO_POOLED * pooled
        s = (1 - TO_IDENTITY) * s + TO_IDENTITY * max(np.trace(s) / p, 1e-6) * np.eye(p)
        lower = np.linalg.cholesky(s)
        factor.append(np.linalg.inv(lower))
        offset.append(np.log(n[k] / n.sum()) - np.log(lower.diagonal()).sum())
    return Model(centre, scale, mean, np.array(factor), np.array(offset))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), 1000):
            x = statistics(batch.column("text").slice(a, 1000))
            offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, 1000), batch.column("held_out").slice(a, 1000),
                                              pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1)))], ["doc_id", "held_out", "x"])


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy().reshape(len(col), len(STATISTICS))


def _sums(centre: np.ndarray | None):
    """Per label: number and sums of the statistics, or their outer products about ``centre``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(STATISTICS)
        total = np.zeros((2, 1 + p if centre is None else p * p))
        for batch in batches:
            x, y = _matrix(batch.column("x")), batch.column("quality").to_numpy()
            for k in (0, 1):
                z = x[y == k]
                total[k] += np.concatenate([[len(z)], z.sum(0)]) if centre is None else ((z - centre).T @ (z - centre)).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], ["i", "v"])
    return run


def _totals(labelled: DataFrame, centre: np.ndarray | None, size: int) -> np.ndarray:
    out = np.zeros(2 * size)
    with freed_shuffles(labelled.sparkSession):
        for r in labelled.mapInArrow(_sums(centre), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # 2 * size numbers
            out[r["i"]] = r["v"]
    return out.reshape(2, size)


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(m.score(_matrix(batch.column("x"))))], ["doc_id", "held_out", "score"])
    return run


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every text; learned from all labelled rows that are not held out.

    ``labels(doc_id, quality)``: a null or other quality than 0 and 1 is no
    label, several labels of an id all count.  A null text is empty, an empty
    text is scored like any other.  Null ids and repeated rows are kept; other
    columns are ignored.  With fewer than two rows of either label every score
    is the share of label 1 (0.5 without labels).
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    vectors = cut(rows.mapInArrow(_vectors, "doc_id long, held_out boolean, x array<double>"))
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1)")
    p = len(STATISTICS)
    labelled = cut(vectors.filter("not held_out").join(known, "doc_id").select("x", "quality"))
    first = _totals(labelled, None, 1 + p)
    n, sums = first[:, 0], first[:, 1:]
    centre = sums.sum(0) / max(n.sum(), 1)
    products = _totals(labelled, centre, p * p).reshape(2, p, p)
    m = discriminant(n, sums - n[:, None] * centre, products, centre)
    model = docs.sparkSession.sparkContext.broadcast((m.centre, m.scale, m.mean, m.factor, m.offset, m.constant))
    scored = vectors.mapInArrow(_scores(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
