"""Near duplicates by ProbMinHash signatures of weighted shingles, banding and exact verification.

A shingle of five words that occurs n times in a text has the weight
1 + ln n.  Each weighted shingle is a Poisson process of arrivals: its first
arrival is exponential with its weight as rate, every arrival falls into a
random register, and a register keeps the shingle that arrives first.  Two
texts agree in a register with exactly their probability Jaccard similarity.
A shingle stops when its next arrival is later than every register's, so most
shingles of a long text are drawn once.

Texts with the same shingles and weights are one representative.  Signatures
are cut into bands; the representatives that share a band are compared with the
smallest of them, and where that leaves a bucket in several components, its
members meet in blocks, so that no link in a bucket goes unseen.  Only links
verified on the whole texts join groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import tokens as tk
from corpusloom.llm.buckets import bucket_links, log_counts, members_of
from corpusloom.llm.common import cut

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 14, 4          # recall 0.9991 at similarity 0.8
PROFILE = log_counts(SHINGLE)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((tk.mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def signatures(h: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """``rows x m`` shingle hashes: per register the shingle whose arrival in it is first."""
    when, who = np.full(rows * m, np.inf), np.zeros(rows * m, np.uint64)
    h, row, weight, t = h.copy(), row.copy(), weight.astype(np.float64), np.zeros(len(h))
    step = np.uint64(0)
    while len(h):
        step += np.uint64(1)
        draw = tk.mix(h + np.multiply(step, tk.BYTE_CODES[1:2]))
        t = t - np.log(_uniform(draw)) / weight
        at = row * m + (tk.mix(draw ^ tk.BYTE_CODES[2]) % np.uint64(m)).astype(np.int64)
        better = np.flatnonzero(t < when[at])
        order = better[np.argsort(-t[better], kind="stable")]  # the earliest is written last
        when[at[order]], who[at[order]] = t[order], h[order]
        live = t < when.reshape(rows, m).max(1)[row]
        h, row, weight, t = h[live], row[live], weight[live], t[live]
    return who.reshape(rows, m)


_SIGNED = "doc_id long, body_a long, body_b long, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col, step = batch.column("text"), 1000
        for a in range(0, len(col), step):
            part = col.slice(a, step)
            h, row, w = PROFILE(part)
            n = len(part)
            sig = signatures(h, row, w, n, BANDS * ROWS)
            body = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
            for i, b in enumerate(body):  # two sums over the weighted shingles name the text's content
                if len(row):
                    b[row[starts]] = np.add.reduceat(tk.mix(h + tk.BYTE_CODES[3 + i] * np.round(np.exp(w - 1)).astype(np.uint64)), starts)
            keys = np.zeros((n, BANDS), np.uint64)
            for j in range(ROWS):
                keys = tk.mix(keys * tk.BYTE_CODES[6] + sig.reshape(n, BANDS, ROWS)[:, :, j])
            keys ^= np.arange(BANDS, dtype=np.uint64) * tk.BYTE_CODES[5]
            some = np.zeros(n, bool)
            some[row] = True
            offsets = pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(a, step), pa.array(body[0].view(np.int64)), pa.array(body[1].view(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(keys[some].reshape(-1).view(np.int64)))], ["doc_id", "body_a", "body_b", "bands"])


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, rep_id, class_id, class_size``, a row for every row of ``docs``.

    ``rep_id`` is the smallest id with the same weighted shingles, ``class_id``
    the smallest id of the near-duplicate class; each class has links of
    similarity 0.8 or more only.  A text of one to four words is one shingle;
    a text without words (null, empty, blanks) and a row with a null id are
    classes of their own (``rep_id`` and ``class_id`` are the row's id);
    repeated rows are copies of each other; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = cut(rows.mapInArrow(_sign, _SIGNED))
    body = ["body_a", "body_b"]
    counted = (F.size("bands") > 0) & F.col("doc_id").isNotNull()
    alike = cut(signed.filter(counted).groupBy(*body).agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("n")))
    # Copies of a text have its bands; distinct pairs of band and representative are left.
    reps = signed.filter(counted).join(alike.select(F.col("rep_id").alias("doc_id")), "doc_id", "left_semi")
    members = members_of(reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("band")).distinct())
    texts = rows.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    texts = cut(texts.groupBy(F.col("doc_id").alias("id")).agg(F.min("text").alias("text")))
    roots = bucket_links(members, texts, PROFILE, SIMILARITY)
    named = alike.join(roots, alike["rep_id"] == roots["node"], "left").select(
        *body, "rep_id", "n", F.coalesce("root", "rep_id").alias("class_id"))
    sizes = named.groupBy("class_id").agg(F.sum("n").alias("class_size"))
    named = named.join(sizes, "class_id").select(*body, "rep_id", "class_id", "class_size")
    found = signed.filter(counted).join(named, body).select("doc_id", "rep_id", "class_id", "class_size")
    alone = signed.filter(~counted).select("doc_id", F.col("doc_id").alias("rep_id"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return found.union(alone)
