"""Exact top-k inner products by vector approximation files.

Vectors are numbers floor(256 x).  Each dimension is divided into sixteen
cells of about equal population; an approximation holds four bits a dimension.
Blocks of approximations meet blocks of queries twice: first every query's k
best lower bounds give a score that its k-th result must reach, then vectors
whose upper bound reaches it are read exactly, in the order of their upper
bounds, until the k-th score is above the next bound.  What leaves a pair of
blocks is at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, first_row

CELLS = 16
BLOCK_ROWS, QUERY_ROWS = 4096, 512
EXACT = 2.0 ** 52  # sums of products below this are exact in double precision

_BLOCK = "block int, n int, ids binary, cells binary, vectors binary, low binary, high binary"


def _blocks(dims: int, borders: np.ndarray):
    """A block's distinct ids with exact vectors, cells and the least and greatest number in each cell."""
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        x = np.zeros((len(ids), dims), np.int64)
        for i, v in enumerate(table.column("v").to_pylist()):
            x[i, :len(v)] = v
        order = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[order], x[order]
        first = np.concatenate([[True], ids[1:] != ids[:-1]])  # of rows with one id the least vector
        ids, x = ids[first], x[first]
        cells = np.stack([np.searchsorted(borders[j], x[:, j], side="right") for j in range(dims)], 1).astype(np.uint8) if dims else np.zeros((len(ids), 0), np.uint8)
        low, high = np.zeros((dims, CELLS), np.int64), np.zeros((dims, CELLS), np.int64)
        for j in range(dims):
            for c in np.unique(cells[:, j]):
                own = x[cells[:, j] == c, j]
                low[j, c], high[j, c] = own.min(), own.max()
        one = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
        return pa.Table.from_arrays([
            pa.array([table.column("block")[0].as_py()], pa.int32()), pa.array([len(ids)], pa.int32()), one(ids), one(cells), one(x),
            one(low), one(high)], names=[s.split()[0] for s in _BLOCK.split(", ")])
    return run


def _matrix(b: bytes, kind: type, columns: int) -> np.ndarray:
    return np.frombuffer(b, kind).reshape(-1, columns)


def bounds(q: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries (rows) with approximations (columns).

    With a query's positive and negative parts p and n the bounds are
    p.low - n.high and p.high - n.low, matrix products over the cells' ends.
    """
    j = np.arange(cells.shape[1])
    lo, hi = low[j, cells].astype(float), high[j, cells].astype(float)
    p, n = np.maximum(q, 0).astype(float), np.maximum(-q, 0).astype(float)
    wide = 1e-9 * (np.abs(q).astype(float) @ np.maximum(np.abs(lo), np.abs(hi)).T) + 1e-6  # beyond rounding of very large sums
    return p @ lo.T - n @ hi.T - wide, p @ hi.T - n @ lo.T + wide


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of one query with rows of ``x``; Python's integers where 64-bit sums could overflow."""
    if not x.size:
        return np.zeros(len(x), np.int64)
    most = float(np.abs(q).max()) * float(np.abs(x).max()) * len(q)
    if most < EXACT:
        return (x.astype(float) @ q.astype(float)).astype(np.int64)
    return (x @ q) if most < 2.0 ** 62 else x.astype(object) @ q.astype(object)


def _lower(dims: int, k: int):
    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        """A block's k best lower bounds for every query."""
        queries, best_of = [np.zeros(0, np.int64)], [np.zeros(0)]
        for b in block.to_pylist():
            ids, cells = np.frombuffer(b["ids"], np.int64), _matrix(b["cells"], np.uint8, dims)
            low, high = _matrix(b["low"], np.int64, CELLS), _matrix(b["high"], np.int64, CELLS)
            for r in asked.to_pylist():
                qid, q = np.frombuffer(r["q_ids"], np.int64), _matrix(r["q_vectors"], np.int64, dims)
                lo, _ = bounds(q, cells, low, high)
                lo[qid[:, None] == ids[None, :]] = -np.inf
                m = min(k, lo.shape[1])
                best = -np.partition(-lo, m - 1, axis=1)[:, :m]
                keep = np.isfinite(best)
                queries.append(np.repeat(qid, m)[keep.reshape(-1)])
                best_of.append(best[keep])
        return pa.Table.from_arrays([pa.array(np.concatenate(queries)), pa.array(np.concatenate(best_of))], names=["query_id", "bound"])
    return run


def _search(dims: int, k: int):
    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        """A block's k greatest products for every query, as far as they can be among the greatest of all."""
        out = []
        for b in block.to_pylist():
            ids, x = np.frombuffer(b["ids"], np.int64), _matrix(b["vectors"], np.int64, dims)
            cells, low, high = _matrix(b["cells"], np.uint8, dims), _matrix(b["low"], np.int64, CELLS), _matrix(b["high"], np.int64, CELLS)
            for r in asked.to_pylist():
                qid, q = np.frombuffer(r["q_ids"], np.int64), _matrix(r["q_vectors"], np.int64, dims)
                _, hi = bounds(q, cells, low, high)
                need = dict(zip(r["need_ids"] or [], r["need"] or []))
                for i, query in enumerate(qid):
                    able = np.flatnonzero((hi[i] >= need.get(int(query), -np.inf)) & (ids != query))
                    able = able[np.argsort(-hi[i, able], kind="stable")]
                    found: list[tuple[int, int]] = []
                    at, step = 0, 16
                    while at < len(able) and (len(found) < k or hi[i, able[at]] >= -found[k - 1][0]):
                        part = able[at:at + step]
                        s = exact(q[i], x[part])
                        found = sorted([*found, *((-int(v), int(j)) for v, j in zip(s, ids[part]))])[:k]
                        at, step = at + step, step * 2
                    out += [(int(query), j, -v) for v, j in found]
        return pa.Table.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])
    return run


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` greatest products of each query with the other vectors.

    Queries are the rows whose id is divisible by ``every``.  A vector that is
    null or holds a null or a non-finite number takes no part, nor does a null
    id.  Of repeated rows with one id the least vector counts.  Shorter vectors
    are continued with zeros.  Ties go to the smaller id.  With no or one
    vector there is no result.  Scores must fit in 64 bits.
    """
    spark = vectors.sparkSession
    bad = F.exists(embedding, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    whole = vectors.filter(F.col(embedding).isNotNull() & F.col(vec_id).isNotNull() & ~F.coalesce(bad, F.lit(False)))
    rows = cut(whole.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, lambda c: F.floor(c.cast("double") * 256)).alias("v")))
    n, dims = first_row(rows.agg(F.count(F.lit(1)), F.max(F.size("v"))))
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = dims or 0
    cuts = rows.select(F.posexplode("v").alias("j", "x")).groupBy("j").agg(F.percentile_approx("x", [i / CELLS for i in range(1, CELLS)], 1000).alias("b"))
    borders = np.zeros((dims, CELLS - 1), np.int64)
    for r in cuts.collect():  # one row a dimension
        borders[r["j"]] = r["b"]
    count = int(n) // BLOCK_ROWS + 1
    placed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))
    blocks = cut(placed.groupBy("block").applyInArrow(_blocks(dims, borders), _BLOCK))
    asked = rows.filter(F.col("vec_id") % every == 0)
    groups = int(first_row(asked.agg(F.count(F.lit(1))))[0]) // QUERY_ROWS + 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    queries = cut(asked.groupBy("block").applyInArrow(_blocks(dims, borders), _BLOCK))
    queries = queries.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    # The stated queries, in blocks, against all blocks of vectors.  Blocks and queries meet as groups: a join would repeat a
    # block's vectors for every block of queries, and Spark takes the repeated queries for small enough to go through the driver.
    def meeting(asked: DataFrame, block: DataFrame, run, schema: str) -> DataFrame:
        sent = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        return block.repartition(count, "block").groupBy("block").cogroup(
            sent.repartition(count, "block").groupBy("block")).applyInArrow(run, schema)

    best = meeting(queries, blocks.select("block", "ids", "cells", "low", "high"), _lower(dims, k), "query_id long, bound double")
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"))
    kth = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).groupBy("query_id").agg(
        F.min("bound").alias("bound"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
    kth = kth.withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    need = cut(kth.groupBy("q_block").agg(F.collect_list("query_id").alias("need_ids"), F.collect_list("bound").alias("need")))  # lists as long as a query block
    found = meeting(queries.join(need, "q_block", "left"), blocks.drop("n"), _search(dims, k), "query_id long, vec_id long, score long")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
