"""Exact similarity search: the best k per query, and all items beyond or within a distance.

Work is done on blocks of vectors with matrix products.  A block is cut into
balls around some of its vectors; a query looks into its nearest balls first and
then only into those that can still hold a better item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.balls import pairs_within  # noqa: F401 - part of this module's interface
from corpusloom.operators.distances import DIGITS, DISTANCES, SIMILARITIES, SLACK, TILE, best_scores, gap, scores
from corpusloom.session import BROADCAST_BYTES, collect_if_small, cut_lineage, matrix

BLOCK_BYTES = 4 * 1024 * 1024
# Beyond this share of balls that may hold a better item, the rest of a block is scored at once.
DENSE_SHARE = 0.5
QUESTIONS = 4096         # questions that look into the balls of a block at a time
LEAST_DISTRICTS = 16     # of a corpus that is cut into cells, for tasks enough
CELL_NUMBERS = 1 << 20   # question-by-cell numbers at a time
WIDTH = 4096             # items that a tile of questions is scored against at a time


class _Best:
    """The k best ``(score, id)`` of some queries, ties to the smaller id."""

    def __init__(self, q_ids: np.ndarray, k: int, exclude_self: bool, least: np.ndarray | None = None, digits: int = DIGITS):
        self.q_ids, self.k, self.exclude_self, self.digits = q_ids, k, exclude_self, digits
        self.score = np.full((len(q_ids), k), -np.inf)
        self.code = np.full((len(q_ids), k), np.iinfo(np.int64).max)
        self.ids: np.ndarray | None = None  # code -> id, in order
        self.least = np.full(len(q_ids), -np.inf) if least is None else least
        self.scored = 0

    def learn(self, c_ids: np.ndarray) -> np.ndarray:
        """Codes of the ids of one block, in the order of all ids that are still held."""
        held = self.score > -np.inf
        known = self.ids[self.code[held]] if held.any() else c_ids[:0]
        ids = np.unique(np.concatenate([known, c_ids]))
        if held.any():
            self.code[held] = np.searchsorted(ids, known)
        self.ids = ids
        self.own = np.searchsorted(ids, self.q_ids) if self.exclude_self else None
        if self.exclude_self and len(ids):
            at = np.minimum(self.own, len(ids) - 1)
            self.own = np.where(ids[at] == self.q_ids, at, -1)
        return np.searchsorted(ids, c_ids)

    def bound(self, rows: np.ndarray | slice) -> np.ndarray:
        """Scores below this cannot be among the best any more."""
        return np.maximum(self.score[rows, -1], self.least[rows])

    def add(self, rows: np.ndarray, s: np.ndarray, codes: np.ndarray) -> None:
        """Take the rounded scores ``s`` of items ``codes`` for the queries ``rows``."""
        if self.exclude_self:
            s[self.own[rows][:, None] == codes[None, :]] = -np.inf
        codes = np.broadcast_to(codes, s.shape)
        if s.shape[1] > self.k:
            edge = np.partition(s, s.shape[1] - self.k, axis=1)[:, -self.k:].min(axis=1)
            # All items at the edge stay, so that ids decide between them.
            width = int((s >= edge[:, None]).sum(axis=1).max())
            if width < s.shape[1]:
                at = np.argpartition(-s, width - 1, axis=1)[:, :width]
                s, codes = np.take_along_axis(s, at, 1), np.take_along_axis(codes, at, 1)
        both, ids = np.concatenate([self.score[rows], s], axis=1), np.concatenate([self.code[rows], codes], axis=1)
        order = np.lexsort((ids, -both), axis=-1)[:, :self.k]
        self.score[rows], self.code[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(ids, order, 1)

    def frame(self) -> pd.DataFrame:
        q, at = np.nonzero((self.score > -np.inf) & (self.score >= self.least[:, None]))
        ids = self.ids[self.code[q, at]] if len(q) else (self.ids if self.ids is not None else self.q_ids)[:0]
        return pd.DataFrame({"q_id": self.q_ids[q], "id": ids, "score": self.score[q, at]})


def _offer(best: _Best, rows: np.ndarray, q: np.ndarray, c: np.ndarray, codes: np.ndarray, metric: str, seen: np.ndarray | None = None) -> None:
    """Score items for the queries ``rows``; items below the bound of all of them are neither rounded nor ordered."""
    for a in range(0, len(c), WIDTH):
        part = slice(a, a + WIDTH)
        s = scores(q[rows], c[part], metric)
        if seen is not None:
            s[seen[:, part]] = -np.inf
        some = (s >= (best.bound(rows) - SLACK)[:, None]).any(axis=0)
        if some.any():
            best.add(rows, np.round(s[:, some], best.digits) + 0.0, codes[part][some])


def _spread_pivots(c: np.ndarray, n: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """``n`` vectors of the block, each the farthest from those before it, and the gaps of all vectors to them."""
    chosen, gaps = [0], np.empty((len(c), n))
    nearest = np.full(len(c), np.inf)
    for i in range(n):
        gaps[:, i] = gap(c, c[chosen[-1]:chosen[-1] + 1], metric)[:, 0]
        nearest = np.minimum(nearest, gaps[:, i])
        chosen.append(int(nearest.argmax()))
    return c[chosen[:n]], gaps


def _search_block(best: _Best, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, metric: str) -> None:
    """Offer a block of items to all queries: nearest balls first, then those that can beat the k-th score."""
    codes = best.learn(c_ids)
    n_balls = int(np.sqrt(len(c)))
    if n_balls < 3 or len(q) < n_balls:
        # Fewer comparisons than the balls themselves would take.
        for start in range(0, len(q), TILE):
            _offer(best, np.arange(start, min(len(q), start + TILE)), q, c, codes, metric)
        best.scored += len(q) * len(c)
        return
    pivots, gaps = _spread_pivots(c, n_balls, metric)
    home = gaps.argmin(axis=1)
    own = gaps[np.arange(len(c)), home]
    order = np.argsort(home, kind="stable")
    start = np.searchsorted(home[order], np.arange(n_balls + 1))
    high, low = np.zeros(n_balls), np.full(n_balls, np.inf)
    np.maximum.at(high, home, own)
    np.minimum.at(low, home, own)
    filled = np.diff(start) > 0
    low = np.where(filled, low, 0.0)
    for a in range(0, len(q), QUESTIONS):
        some = np.arange(a, min(len(q), a + QUESTIONS))
        ceiling = best_scores(q[some], pivots, gap(q[some], pivots, metric), low, high, metric) + SLACK
        ceiling[:, ~filled] = -np.inf
        _search_balls(best, some, ceiling, q, c, codes, metric, home, order, start)


def _search_balls(best: _Best, asked: np.ndarray, ceiling: np.ndarray, q: np.ndarray, c: np.ndarray, codes: np.ndarray, metric: str,
                  home: np.ndarray, order: np.ndarray, start: np.ndarray) -> None:
    """The balls of a block for the queries ``asked``, each from its best ceiling on."""
    visit = np.argsort(-ceiling, axis=1, kind="stable")
    for turn in range(ceiling.shape[1]):
        top = np.take_along_axis(ceiling, visit[:, turn:turn + 1], 1)[:, 0]
        live = np.flatnonzero((top >= best.bound(asked)) & (top > -np.inf))
        if not len(live):
            return
        if turn == 2 and (ceiling[live] >= best.bound(asked[live])[:, None]).mean() > DENSE_SHARE:
            seen = np.zeros((len(live), ceiling.shape[1]), bool)
            np.put_along_axis(seen, visit[live, :turn], True, 1)
            for a in range(0, len(live), TILE):
                _offer(best, asked[live[a:a + TILE]], q, c, codes, metric, seen[a:a + TILE][:, home])
            best.scored += len(live) * len(c)
            return
        ball = visit[live, turn]
        by = np.argsort(ball, kind="stable")
        for some in np.split(live[by], np.flatnonzero(np.diff(ball[by])) + 1):
            j = visit[some[0], turn]
            members = order[start[j]:start[j + 1]]
            for a in range(0, len(some), TILE):
                _offer(best, asked[some[a:a + TILE]], q, c[members], codes[members], metric)
            best.scored += len(some) * len(members)


def _scan(batches: Iterator[pd.DataFrame], q_ids, q, k, metric, exclude_self, block, least, digits) -> Iterator[pd.DataFrame]:
    """Running best k per query over one corpus partition, block by block."""
    best, held, n = _Best(q_ids, k, exclude_self, np.full(len(q_ids), least), digits), [], 0

    def offer():
        pdf = pd.concat(held)
        held.clear()
        _search_block(best, q, pdf["id"].to_numpy(), matrix(pdf["vec"]), metric)

    for pdf in batches:
        if len(pdf):
            held.append(pdf)
            n += len(pdf)
        if n >= block:
            offer()
            n = 0
    if held:
        offer()
    if best.ids is not None:
        yield _counted(best)


def _counted(best: _Best) -> pd.DataFrame:
    """What was found, with the number of scored pairs on the first row; a row of score -inf carries it when nothing was found."""
    out = best.frame()
    if out.empty and best.scored:
        out = pd.DataFrame({"q_id": best.q_ids[:1], "id": best.ids[:1], "score": [-np.inf]})
    scored = np.zeros(len(out), np.int64)
    scored[:1] = best.scored
    return out.assign(scored=scored)


def _grid_topk(left: pd.DataFrame, right: pd.DataFrame, k, metric, exclude_self, digits) -> pd.DataFrame:
    least = left["least"].to_numpy(dtype=float) if len(left) else None
    best = _Best(left["q_id"].to_numpy(), k, exclude_self, least, digits)
    if len(left) and len(right):
        _search_block(best, matrix(left["vec"]), right["id"].to_numpy(), matrix(right["vec"]), metric)
    else:
        best.ids = right["id"].to_numpy()[:0]
    return _counted(best)


# --------------------------------------------------------------------------
# Question sets too large to ship: cells of the corpus
# --------------------------------------------------------------------------

@dataclass(frozen=True)
class _Cells:
    """Pivots and, per cell, what is known of its members and the district it lies in; bounded by the broadcast limit."""

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray
    district: np.ndarray


def _to_cells(batches, pivots, metric):
    for pdf in batches:
        for part in _few(pdf, len(pivots)):
            gaps = gap(matrix(part["vec"]), pivots, metric)
            cell = gaps.argmin(axis=1)
            yield part.assign(cell=cell.astype(np.int32), gap=gaps[np.arange(len(part)), cell])


def _few(pdf: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    """The rows in slices of which ``width`` numbers a row fill at most ``CELL_NUMBERS``."""
    step = max(1, CELL_NUMBERS // width)
    for a in range(0, len(pdf), step):
        yield pdf.iloc[a:a + step]


def _districts(pivots: np.ndarray, n: np.ndarray, rows: int, metric: str) -> np.ndarray:
    """District of every cell, from 0: neighbouring cells with about ``rows`` members together."""
    centers, _ = _spread_pivots(pivots, int(min(len(pivots), max(1, n.sum() // rows))), metric)
    order = np.argsort(gap(pivots, centers, metric).argmin(axis=1), kind="stable")
    out = np.empty(len(pivots), np.int32)
    out[order] = np.unique((np.cumsum(n[order]) - n[order]) // rows, return_inverse=True)[1]
    return out


def _visits(batches, cells: _Cells, metric: str, enough: int, second: bool):
    """First visit: the districts of the nearest cells, until these have ``enough`` members.  Second: all others with a cell that can beat ``least``.

    A question has at most one row per district, however many cells it asks for.
    """
    by = np.argsort(cells.district, kind="stable")
    starts = np.flatnonzero(np.diff(cells.district[by], prepend=-1))
    for pdf in batches:
        for part in _few(pdf, len(cells.pivots)):
            q, least = matrix(part["vec"]), part["least"].to_numpy(dtype=float)
            to_pivot = gap(q, cells.pivots, metric)
            order = np.argsort(np.where(cells.n > 0, to_pivot, np.inf), axis=1, kind="stable")
            before = np.cumsum(cells.n[order], axis=1) - cells.n[order]
            first = np.zeros(order.shape, bool)
            np.put_along_axis(first, order, before < enough, 1)
            take = np.logical_or.reduceat((first & (cells.n > 0))[:, by], starts, axis=1)
            if second:
                ceiling = best_scores(q, cells.pivots, to_pivot, cells.low, cells.high, metric) + SLACK
                able = (cells.n > 0) & (ceiling >= least[:, None])
                take = ~take & np.logical_or.reduceat(able[:, by], starts, axis=1)
            row, district = np.nonzero(take)
            yield pd.DataFrame({"q_id": part["q_id"].to_numpy()[row], "vec": part["vec"].to_numpy()[row],
                                "least": least[row], "district": district.astype(np.int32)})


def _best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), F.asc("id"))
    return found.where(F.col("score") > float("-inf")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _cell_search(q: DataFrame, c: DataFrame, k: int, metric: str, exclude_self: bool, out: T.StructType, dim: int, pivot_bytes: int,
                 least: float, digits: int) -> DataFrame:
    """Two visits over cells of the corpus.

    Neighbouring cells make up districts, and a question goes to a district
    once, where balls narrow the search again.  Districts and question lists
    are cut into blocks, so none of them is one task; either side is copied
    once per block of the other, at most.
    """
    spark = c.sparkSession
    n = c.count()
    if not n:
        return spark.createDataFrame([], out)
    rows = max(256, min(BLOCK_BYTES // (4 * dim), n // LEAST_DISTRICTS))
    n_pivots = int(max(1, min(pivot_bytes // (8 * dim), n // max(16, min(rows, int(np.sqrt(n)))))))
    pivots = matrix(c.orderBy(F.xxhash64("id")).limit(n_pivots).toPandas()["vec"])  # within pivot_bytes
    fields = T.StructType([*c.schema, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())])
    placed = cut_lineage(c.mapInPandas(partial(_to_cells, pivots=pivots, metric=metric), fields))
    low, high, count = np.zeros(len(pivots)), np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in placed.groupBy("cell").agg(F.min("gap").alias("a"), F.max("gap").alias("b"), F.count(F.lit(1)).alias("n")).collect():  # one row per pivot
        low[r["cell"]], high[r["cell"]], count[r["cell"]] = r["a"], r["b"], r["n"]
    cells = _Cells(pivots, low, high, count, _districts(pivots, count, rows, metric))
    parts = -(-np.bincount(cells.district, count).astype(np.int64) // rows)
    home = spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(pivots), dtype=np.int32), "district": cells.district}), "cell int, district int")
    routed = T.StructType([*q.schema, T.StructField("least", T.DoubleType()), T.StructField("district", T.IntegerType())])

    def visit(asked: DataFrame, second: bool) -> DataFrame:
        routes = cut_lineage(asked.mapInPandas(partial(_visits, cells=cells, metric=metric, enough=k + exclude_self, second=second), routed))
        asking = np.zeros(len(parts), np.int64)
        for r in routes.groupBy("district").count().collect():  # at most one row per pivot
            asking[r["district"]] = -(-r["count"] // rows)
        blocks = spark.createDataFrame(pd.DataFrame({"district": np.arange(len(parts), dtype=np.int32), "cp": parts, "qp": asking}), "district int, cp bigint, qp bigint")
        blocks = F.broadcast(blocks.where("cp > 0 and qp > 0"))  # at most one row per pivot, as ``home``
        upto = lambda name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(name) - 1))
        left = routes.join(blocks, "district").withColumn("qb", F.pmod(F.xxhash64("q_id"), "qp")).withColumn("cb", upto("cp"))
        right = placed.join(F.broadcast(home), "cell").join(blocks, "district").withColumn("cb", F.pmod(F.xxhash64("id"), "cp")).withColumn("qb", upto("qp"))
        keys = ["district", "qb", "cb"]
        merge = partial(_grid_topk, k=k, metric=metric, exclude_self=exclude_self, digits=digits)
        return cut_lineage(left.select(*keys, "q_id", "vec", "least").groupBy(*keys).cogroup(right.select(*keys, "id", "vec").groupBy(*keys)).applyInPandas(merge, out))

    start = q.withColumn("least", F.lit(least))
    first = visit(start, False)
    kept = _best_of(first, k)
    bound = kept.groupBy("q_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    again = q.join(bound, "q_id", "left").withColumn("least", F.coalesce("least", F.lit(least)))
    return first.unionByName(visit(again, True))


def top_matches(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    query: tuple[str, str] = ("q_id", "q_vec"),
    item: tuple[str, str] = ("id", "embedding"),
    metric: str = "cosine",
    cutoff: float | None = None,
    exclude_self: bool = False,
    least: float = float("-inf"),
    digits: int = DIGITS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The k best corpus items of each query: ``q_id, id, score, rank``.

    Scores are rounded to ``digits`` digits and ties go to the smaller id, so a rank
    does not depend on how rows were batched.  With a similarity metric the
    cutoff keeps scores at or above it, with a distance at or below it; it is
    applied after the top k.  Items of a score below ``least`` (a negated distance)
    are not looked for.  Queries that fit ``broadcast_bytes`` are shipped
    to the corpus scan (no shuffle of the corpus).  Beyond that the corpus is
    cut into cells: a query visits the districts of its nearest cells for a first
    k-th score and then only those with a cell that can beat it.
    """
    found = _found(queries, corpus, k, query, item, metric, exclude_self, broadcast_bytes, least, digits)
    ranked = _best_of(found.drop("scored"), k)
    if metric in DISTANCES:
        ranked = ranked.withColumn("score", F.lit(0.0) - F.col("score"))
    if cutoff is not None:
        ranked = ranked.where(F.col("score") >= cutoff if metric in SIMILARITIES else F.col("score") <= cutoff)
    return ranked


def scored_pairs(queries: DataFrame, corpus: DataFrame, k: int, *, query: tuple[str, str] = ("q_id", "q_vec"),
                 item: tuple[str, str] = ("id", "embedding"), metric: str = "cosine", exclude_self: bool = False,
                 broadcast_bytes: int = BROADCAST_BYTES) -> int:
    """How many pairs ``top_matches`` scores; all others are skipped by their balls."""
    found = _found(queries, corpus, k, query, item, metric, exclude_self, broadcast_bytes)
    return found.agg(F.sum("scored")).first()[0] or 0


def _found(queries, corpus, k, query, item, metric, exclude_self, broadcast_bytes, least=float("-inf"), digits=DIGITS) -> DataFrame:
    """Partial results ``q_id, id, score, scored``: at least the k best of each query."""
    if metric not in SIMILARITIES + DISTANCES:
        raise ValueError(f"unsupported metric {metric!r}; supported: {SIMILARITIES + DISTANCES}")
    q = queries.select(F.col(query[0]).alias("q_id"), F.col(query[1]).alias("vec")).where("vec is not null")
    c = corpus.select(F.col(item[0]).alias("id"), F.col(item[1]).alias("vec")).where("vec is not null")
    out = T.StructType([
        T.StructField("q_id", q.schema["q_id"].dataType),
        T.StructField("id", c.schema["id"].dataType),
        T.StructField("score", T.DoubleType()),
        T.StructField("scored", T.LongType()),
    ])
    first = q.select(F.size("vec").alias("d")).first()
    dim = first["d"] if first else 1
    small = collect_if_small(q, max(1, broadcast_bytes // (8 * dim)))
    if small is None:
        return _cell_search(q, c, k, metric, exclude_self, out, dim, broadcast_bytes, least, digits)
    scan = partial(_scan, q_ids=small["q_id"].to_numpy(), q=matrix(small["vec"]), k=k, metric=metric,
                   exclude_self=exclude_self, block=max(256, BLOCK_BYTES // (4 * dim)), least=least, digits=digits)
    return c.mapInPandas(scan, out)


def _beyond(q_ids, q, c_ids, c, threshold, keep, metric) -> Iterator[pd.DataFrame]:
    for start in range(0, len(q), TILE):
        d = np.round(-scores(q[start:start + TILE], c, metric), DIGITS) + 0.0
        qi, ci = np.nonzero(d > threshold if keep == "farther" else d <= threshold)
        yield pd.DataFrame({"q_id": q_ids[qi + start], "id": c_ids[ci], "distance": d[qi, ci]})


def _beyond_blocks(left: pd.DataFrame, right: pd.DataFrame, threshold, keep, metric) -> pd.DataFrame:
    if left.empty or right.empty:
        return pd.DataFrame({"q_id": left["q_id"][:0], "id": right["id"][:0], "distance": np.empty(0)})
    return pd.concat(_beyond(left["q_id"].to_numpy(), matrix(left["vec"]), right["id"].to_numpy(), matrix(right["vec"]), threshold, keep, metric))


def threshold_matches(
    queries: DataFrame, corpus: DataFrame, threshold: float, *, keep: str = "farther",
    query: tuple[str, str] = ("q_id", "q_vec"), item: tuple[str, str] = ("id", "embedding"),
    metric: str = "cosine_distance", query_block: int = 4096, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """All items on one side of a distance threshold: ``q_id, id, distance``.

    ``farther`` keeps distances above it, ``nearer`` those up to it.  Questions
    that fit ``broadcast_bytes`` go to the corpus scan; more of them meet the
    corpus in blocks of ``query_block`` rows on either side.
    """
    if keep not in ("farther", "nearer"):
        raise ValueError("keep must be 'farther' or 'nearer'")
    q = queries.select(F.col(query[0]).alias("q_id"), F.col(query[1]).alias("vec")).where("vec is not null")
    c = corpus.select(F.col(item[0]).alias("id"), F.col(item[1]).alias("vec")).where("vec is not null")
    out = T.StructType([
        T.StructField("q_id", q.schema["q_id"].dataType), T.StructField("id", c.schema["id"].dataType),
        T.StructField("distance", T.DoubleType())])
    first = q.select(F.size("vec").alias("d")).first()
    small = collect_if_small(q, max(1, broadcast_bytes // (8 * first["d"]))) if first else q.toPandas()
    if small is None:
        left, right, keys = _grid(q, c, query_block)
        run = partial(_beyond_blocks, threshold=threshold, keep=keep, metric=metric)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: run(a, b), out)

    def scan(batches, ids=small["q_id"].to_numpy(), vecs=matrix(small["vec"])):
        for pdf in batches:
            if len(pdf):
                yield from _beyond(ids, vecs, pdf["id"].to_numpy(), matrix(pdf["vec"]), threshold, keep, metric)

    return c.mapInPandas(scan, out)


def _grid(q: DataFrame, c: DataFrame, rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides in blocks by a hash of their ids, each block once for every block of the other side."""
    nq, nc = (max(1, -(-x.count() // rows)) for x in (q, c))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = q.withColumn("qb", F.pmod(F.xxhash64("q_id"), F.lit(nq))).withColumn("cb", every(nc))
    right = c.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(nc))).withColumn("qb", every(nq))
    return left, right, ["qb", "cb"]


def distinct_vectors(vectors: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """One row per distinct vector: smallest id, the vector, number of copies."""
    return vectors.groupBy(F.col(vec_col).alias("embedding")).agg(
        F.min(id_col).alias("id"), F.count(F.lit(1)).alias("copies")
    ).select("id", "embedding", "copies")


def copy_map(vectors: DataFrame, reps: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """``id, rep``: every vector's id and the id that stands for its copies.

    The copies side may be as hot as it likes: each vector has one row in
    ``reps``, so a skewed join splits freely.
    """
    left = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("_v")).withColumn("_h", F.xxhash64("_v"))
    right = reps.select(F.col("id").alias("rep"), F.col("embedding").alias("_v")).withColumn("_h", F.xxhash64("_v"))
    return left.join(right, ["_h", "_v"]).select("id", "rep")
