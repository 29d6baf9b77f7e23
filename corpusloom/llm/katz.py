"""Katz back-off scoring of whole texts with a bigram model counted over the corpus.

Every word is counted; counts 1..5 are discounted by Good-Turing, and the
freed mass of a context goes to the words it was never followed by, in
proportion to their own discounted unigram probability, so that for every
context the probabilities of all words, the end and the unknown word sum to 1.

Flow: texts become chunks of word numbers (``_chunks``); distinct words per
chunk are counted into a word table with frequency-ranked numbers; its rows go
back to the chunks, which then send their distinct bigrams to groups of
contexts (``_bigrams``).  A group merges its part of the model (written as a
table), scores every bigram occurrence and returns sums per text.  A context
with more than its share of the corpus is spread over all groups by its next
word; only its sums, not its bigrams, are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import tokens as tk
from corpusloom.llm.common import cut, drop_cut, first_row, parts_for
from corpusloom.operators.ordered import arrange, number_rows

K = 5                       # counts above this are not discounted
CHUNK_TOKENS = 1_000_000    # a chunk closes at the first text that reaches this
GROUP_TOKENS = 2_000_000    # training tokens per group of contexts
LEAST_SPREAD = 10_000       # contexts seen less often are never spread over groups
END = np.uint64(0x454E44)   # stands for the end of a text among the word hashes
_FIRST, _UNKNOWN = -2, -1   # numbers of the start context and of words not in the training texts


def _pack(a: np.ndarray, kind: type) -> bytes:
    """Byte planes, compressed: small numbers cost little."""
    a = np.ascontiguousarray(a, kind)
    return zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def _unpack(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


_CHUNK = "chunk long, ids array<long>, held array<boolean>, lens array<int>, tokens binary, words array<long>, counts array<long>"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    ids, held, lens, hashes, size = [], [], [], [], 0

    def close() -> pa.RecordBatch:
        h, n, out = np.concatenate(hashes), np.concatenate(lens), np.concatenate(held)
        words, local = np.unique(h, return_inverse=True)
        train = np.bincount(local[np.repeat(~out, n)], minlength=len(words))
        one = lambda x, t: pa.array([x], t)
        return pa.RecordBatch.from_arrays([
            one((part << 24) + made, pa.int64()), one([i for x in ids for i in x], pa.list_(pa.int64())),
            one(out, pa.list_(pa.bool_())), one(n.astype(np.int32), pa.list_(pa.int32())),
            one(_pack(local, np.int32), pa.binary()), one(words.view(np.int64), pa.list_(pa.int64())),
            one(train, pa.list_(pa.int64()))], names=["chunk", "ids", "held", "lens", "tokens", "words", "counts"])

    for batch in batches:
        w = tk.words(batch.column("text"))
        n = w.counts + 1
        h = np.empty(int(n.sum()), np.uint64)
        is_end = np.zeros(len(h), bool)
        is_end[np.cumsum(n) - 1] = True
        h[is_end], h[~is_end] = END, w.hash
        doc, out = batch.column("doc_id").to_pylist(), batch.column("held_out").to_numpy(zero_copy_only=False)
        a = at = 0
        for i, k in enumerate(np.cumsum(n)):
            if size + k - at >= CHUNK_TOKENS or i == len(n) - 1:
                ids.append(doc[a:i + 1]), held.append(out[a:i + 1]), lens.append(n[a:i + 1]), hashes.append(h[at:k])
                size, a, at = size + int(k - at), i + 1, int(k)
                if size >= CHUNK_TOKENS:
                    yield close()
                    ids, held, lens, hashes, size, made = [], [], [], [], 0, made + 1
    if size:
        yield close()


def discounts(n: list[float]) -> np.ndarray:
    """Good-Turing factors for counts 0..K from the numbers of items seen 1..K+1 times.

    Where the counts of counts give no factor in (0, 1], the count is kept.
    """
    d = np.ones(K + 1)
    if n[0] > 0:
        top = (K + 1) * n[K] / n[0]
        for r in range(1, K + 1):
            if n[r - 1] > 0 and top < 1:
                f = ((r + 1) * n[r] / (n[r - 1] * r) - top) / (1 - top)
                d[r] = f if 0 < f <= 1 else 1.0
    return d


def factor(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c <= K, d[np.minimum(c, K).astype(np.int64)], 1.0)


class Unigrams:
    """Probabilities of words from their counts; ``unknown`` is the mass of all unseen words."""

    def __init__(self, n_train: int, n_of: list[float]):
        self.n, self.d = max(n_train, 1), discounts(n_of)
        seen = sum((1 - self.d[r]) * r * n_of[r - 1] for r in range(1, K + 1)) / self.n
        # Without any discount one token's worth is set aside.
        self.scale, self.unknown = (1.0, seen) if seen > 0 else (self.n / (self.n + 1), 1 / (self.n + 1))
        if n_train == 0:
            self.unknown = 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, factor(c, self.d) * c / self.n * self.scale, self.unknown)


_BLOB = "grp int, chunk long, n_docs int, ctx binary, word binary, wc binary, cnt binary, occ binary, doc binary, info binary"


def _bigrams(groups: int, hot_from: float, totals: dict):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Chunk rows (left) and the numbers and counts of their words (right)."""
        out = []
        for row in left.to_pylist():
            n_words = row["n_words"]
            number, count = np.full(n_words + 1, _UNKNOWN, np.int64), np.zeros(n_words + 1, np.int64)
            at = right.column("pos").to_numpy()
            number[at], count[at] = right.column("number").to_numpy(), right.column("c").to_numpy()
            number[-1], count[-1] = _FIRST, totals["texts"]
            tok, lens = _unpack(row["tokens"], np.int32).astype(np.int64), np.array(row["lens"], np.int64)
            held, doc = np.array(row["held"], bool), np.repeat(np.arange(len(lens)), lens)
            ctx = np.empty_like(tok)
            ctx[1:], ctx[np.concatenate([[0], np.cumsum(lens)[:-1]])] = tok[:-1], n_words
            c = count[tok]
            base = np.bincount(doc, np.log10((c + 1) / (totals["n"] + totals["v"] + 1.0)), len(lens))
            known = np.bincount(doc, c > 0, len(lens)).astype(np.int64)
            key, which = np.unique(ctx * (n_words + 1) + tok, return_inverse=True)
            train = np.bincount(which[~held[doc]], minlength=len(key))
            kc, kw = key // (n_words + 1), key % (n_words + 1)
            x, y = number[kc], number[kw]
            spread = tk.mix(x.view(np.uint64) * np.uint64(3) + np.where(count[kc] >= hot_from, y, 0).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            grp = (spread % np.uint64(groups)).astype(np.int64)
            order = np.lexsort((y, x, grp))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            which = place[which]
            by = np.argsort(which, kind="stable")
            occ, occ_doc = np.bincount(which, minlength=len(key)), doc[by]
            ends = np.searchsorted(grp[order], np.arange(groups + 1))
            occ_at = np.concatenate([[0], np.cumsum(occ)])
            x, y, wc, train = x[order], y[order], count[kw][order], train[order]
            for g in range(groups):
                a, b = ends[g], ends[g + 1]
                if a < b:
                    out.append((g, row["chunk"], len(lens), _pack(np.diff(x[a:b], prepend=0), np.int64), _pack(y[a:b], np.int64),
                                _pack(wc[a:b], np.int64), _pack(train[a:b], np.int32), _pack(occ[a:b], np.int32),
                                _pack(occ_doc[occ_at[a]:occ_at[b]], np.int32), None))
            info = np.concatenate([base, known.astype(float), lens.astype(float)])
            out.append((-1, row["chunk"], len(lens), None, None, None, None, None, None, info.tobytes()))
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 7]
        names = [x.split()[0] for x in _BLOB.split(", ")]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)
    return run


def _keys(table: pa.Table):
    for r in table.select(["ctx", "word", "wc", "cnt"]).to_pylist():
        yield np.cumsum(_unpack(r["ctx"], np.int64)), _unpack(r["word"], np.int64), _unpack(r["wc"], np.int64), _unpack(r["cnt"], np.int32)


_MODEL = "grp int, ctx binary, word binary, cnt binary, n_of array<long>, hot array<struct<ctx:long,low:array<double>,high:double,lower:double>>"


def _merge(hot: dict, uni: Unigrams):
    """One row per group: its bigrams in order with their counts, and its share of the sums of hot contexts."""
    def run(table: pa.Table) -> pa.Table:
        grp = table.column("grp")[0].as_py()
        parts = list(_keys(table))
        x, y, wc, c = (np.concatenate([p[i] for p in parts]) for i in range(4))
        x, y, wc, c = (a[c > 0] for a in (x, y, wc, c))
        order = np.lexsort((y, x))
        x, y, wc, c = x[order], y[order], wc[order], c[order].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, np.int64)
        x, y, wc, c = x[new], y[new], wc[new], np.add.reduceat(c, new) if len(new) else c
        n_of = [int((c == r).sum()) for r in range(1, K + 2)]
        sums = []
        for h in hot:
            m = x == h
            if m.any():
                sums.append({"ctx": h, "low": [float(c[m & (c == r)].sum()) for r in range(1, K + 1)],
                             "high": float(c[m & (c > K)].sum()), "lower": float(uni.p(wc[m]).sum())})
        kind = pa.list_(pa.struct([("ctx", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.float64()), ("lower", pa.float64())]))
        return pa.Table.from_arrays([
            pa.array([grp], pa.int32()), pa.array([_pack(np.diff(x, prepend=0), np.int64)]), pa.array([_pack(y, np.int64)]),
            pa.array([_pack(c, np.int64)]), pa.array([n_of], pa.list_(pa.int64())), pa.array([sums], kind)],
            names=["grp", "ctx", "word", "cnt", "n_of", "hot"])
    return run


def context_mass(low: np.ndarray, high: np.ndarray, lower: np.ndarray, d: np.ndarray, floor: float):
    """Total, scale of seen words and back-off weight of contexts from their sums by count.

    A context whose counts leave nothing after discounting gives up one
    count's worth, so unseen words always have a share.
    """
    total = low.sum(-1) + high
    kept = (low * d[1:]).sum(-1) + high
    scale = np.where(total - kept > 1e-9 * total, 1.0, total / (total + 1))
    left = 1 - kept * scale / total
    return total, scale, left / np.maximum(1 - lower, floor)


def _score(hot: dict, uni: Unigrams, d: np.ndarray):
    def run(model: pa.Table, blobs: pa.Table) -> pa.Table:
        m = model.to_pylist()[0]
        x, y, c = np.cumsum(_unpack(m["ctx"], np.int64)), _unpack(m["word"], np.int64), _unpack(m["cnt"], np.int64)
        starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
        ctx = x[starts]
        rows = blobs.to_pylist()
        kx, ky, kwc = (np.concatenate([f(r) for r in rows]) for f in (
            lambda r: np.cumsum(_unpack(r["ctx"], np.int64)), lambda r: _unpack(r["word"], np.int64), lambda r: _unpack(r["wc"], np.int64)))
        at = np.full(len(kx), -1)
        if len(x):  # a group has far fewer than 2**30 contexts
            where = np.minimum(np.searchsorted(ctx, kx), len(ctx) - 1)
            known = ctx[where] == kx
            group = np.searchsorted(ctx, x)
            pairs, asked = (group << 33) + y + 1, (where << 33) + ky + 1
            found = np.minimum(np.searchsorted(pairs, asked), len(pairs) - 1)
            at = np.where(known & (pairs[found] == asked), found, -1)
        lower = uni.p(kwc)
        value = np.log10(lower)
        if len(x):
            own = np.zeros(len(x))
            own[at[at >= 0]] = lower[at >= 0]
            add = lambda v: np.add.reduceat(v, starts)
            low = np.stack([add(np.where(c == r, c, 0)) for r in range(1, K + 1)], 1).astype(float)
            high, below = add(np.where(c > K, c, 0)).astype(float), add(own)
            for i, h in enumerate(ctx):
                if int(h) in hot:
                    low[i], high[i], below[i] = hot[int(h)]
            total, scale, back = context_mass(low, high, below, d, uni.unknown)
            seen = np.log10(factor(c, d) * c * scale[group] / total[group])
            value += np.where(known, np.log10(back[where]), 0.0)
            value[at >= 0] = seen[at[at >= 0]]
        if hot:  # a spread context may have no training bigram in this group
            table = {h: np.log10(context_mass(np.array(s[0]), np.array(s[1]), np.array(s[2]), d, uni.unknown)[2]) for h, s in hot.items()}
            for h, b in table.items():
                if not len(x) or h not in ctx:
                    value[kx == h] += b
        out, a = [], 0
        for r in rows:
            occ = _unpack(r["occ"], np.int32)
            doc = _unpack(r["doc"], np.int32)
            out.append(np.bincount(doc, np.repeat(value[a:a + len(occ)], occ), r["n_docs"]).tobytes())
            a += len(occ)
        return pa.Table.from_arrays([blobs.column("chunk"), pa.array(out, pa.binary())], names=["chunk", "part"])
    return run


_OUT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, chunk long, place int")


def _finish(train_tokens: int):
    def run(info: pa.Table, parts: pa.Table) -> pa.Table:
        row = info.to_pylist()[0]
        base, known, lens = np.frombuffer(row["info"]).reshape(3, -1)
        score = np.zeros(len(base))
        for p in parts.column("part").to_pylist():
            score += np.frombuffer(p)
        n = len(base)
        return pa.Table.from_arrays([
            pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lens.astype(np.int64)),
            pa.array(known.astype(np.int64)), pa.array(np.full(n, train_tokens)), pa.array(base), pa.array(score),
            pa.array(np.full(n, row["chunk"])), pa.array(np.arange(n, dtype=np.int32))], names=[x.split()[0] for x in _OUT.split(", ")])
    return run


def katz_scores(docs: DataFrame, held_out, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Score every text: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``held_out`` is a boolean Column; rows where it is true are scored but not
    learned from.  Words are lower-cased in A-Z and end in one end token.  A
    null text is empty, an empty text is its end token; a null id is kept and
    its row counts as training; every repeated row is counted and scored on
    its own; other columns are ignored.  Without training rows all
    probability is on the unknown word.  ``chunk, place`` number the rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    chunks = cut(rows.mapInArrow(_chunks, _CHUNK))
    counted = chunks.select(F.explode(F.arrays_zip("words", "counts")).alias("e")).filter("e.counts > 0")
    vocabulary = cut(counted.groupBy(F.col("e.words").alias("w")).agg(F.sum("e.counts").alias("c")))
    s = first_row(vocabulary.agg(F.sum("c"), F.count("c"), *[F.count(F.when(F.col("c") == r, 1)) for r in range(1, K + 2)]))
    texts = first_row(chunks.select(F.explode("held").alias("h")).agg(F.count(F.when(~F.col("h"), 1))))[0]
    totals = {"n": s[0] or 0, "v": s[1], "texts": texts}
    uni = Unigrams(totals["n"], [float(v) for v in s[2:]])
    numbered = number_rows(arrange(vocabulary, F.desc("c"), "w"), name="number").select("w", "c", "number")
    groups = parts_for(spark, totals["n"], GROUP_TOKENS)
    hot_from = max(totals["n"] / (4 * groups), LEAST_SPREAD)
    asked = chunks.select(F.col("chunk").alias("of_chunk"), F.posexplode("words").alias("pos", "w"))
    answers = cut(asked.join(numbered, "w").select("of_chunk", "pos", "number", "c"))
    slim = cut(chunks.select("chunk", "ids", "held", "lens", "tokens", F.size("words").alias("n_words")))
    drop_cut(chunks)
    drop_cut(vocabulary)
    blobs = cut(slim.select("chunk", "held", "lens", "tokens", "n_words").groupBy("chunk")
                .cogroup(answers.groupBy("of_chunk")).applyInArrow(_bigrams(groups, hot_from, totals), _BLOB))
    hot = [r["number"] for r in numbered.filter(F.col("c") >= hot_from).select("number").collect()]  # at most 4 * groups
    hot += [_FIRST] if texts >= hot_from else []
    chunk_rows = cut(slim.select("chunk", "ids", "held"))
    drop_cut(slim)
    drop_cut(answers)
    found = blobs.filter("grp >= 0")
    model = cut(found.select("grp", "ctx", "word", "wc", "cnt").groupBy("grp").applyInArrow(_merge(dict.fromkeys(hot), uni), _MODEL))
    n_of = first_row(model.agg(*[F.sum(F.col("n_of")[r]) for r in range(K + 1)]))
    d = discounts([float(v or 0) for v in n_of])
    sums = model.select(F.explode("hot").alias("h")).groupBy("h.ctx").agg(
        *[F.sum(F.col("h.low")[r]).alias(f"l{r}") for r in range(K)], F.sum("h.high").alias("high"), F.sum("h.lower").alias("lower"))
    hot_sums = {r["ctx"]: ([r[f"l{i}"] for i in range(K)], r["high"], r["lower"]) for r in sums.collect()}
    parts = cut(model.select("grp", "ctx", "word", "cnt").groupBy("grp").cogroup(
        found.select("grp", "chunk", "n_docs", "ctx", "word", "wc", "occ", "doc").groupBy("grp"))
        .applyInArrow(_score(hot_sums, uni, d), "chunk long, part binary"))
    info = blobs.filter("grp = -1").select("chunk", "info").join(chunk_rows, "chunk")
    return info.groupBy("chunk").cogroup(parts.groupBy("chunk")).applyInArrow(_finish(totals["n"]), _OUT)
