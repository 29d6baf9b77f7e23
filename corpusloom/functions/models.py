"""Plug-in points for models, with deterministic offline defaults.

Every plug-in is a callable on Columns; a user's own model goes in as an
iterator ``pandas_udf`` that loads its weights once per worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as tx


class Embedder(Protocol):
    name: str
    dim: int

    def __call__(self, text: Column) -> Column: ...


Summarizer = Callable[[Column, int], Column]
Answerer = Callable[[Column, Column], Column]
Reranker = Callable[[Column, Column], Column]
TokenCounter = Callable[[Column], Column]

# Fixed value: words whose bucket a worker remembers, a few MB; a vocabulary has no bound of its own.
REMEMBERED = 1 << 15


class _Buckets(dict):
    """Word to hash bucket, filled on first use and bounded in size."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = int(hashlib.md5(word.encode("utf-8")).hexdigest()[:8], 16) % self.dim
        return found

    def __reduce__(self):
        return _Buckets, (self.dim,)


def hash_vector(text: str | None, buckets: _Buckets) -> np.ndarray:
    """Word counts by bucket (first 32 bits of the word's MD5), scaled to unit length."""
    ids = list(map(buckets.__getitem__, (text or "").lower().split()))
    counts = np.bincount(ids, minlength=buckets.dim).astype(np.float64) if ids else np.zeros(buckets.dim)
    return (counts / (np.sqrt(counts @ counts) + 1e-9)).astype(np.float32)


@dataclass(frozen=True)
class HashEmbedder:
    """Bag-of-words feature hashing.

    It stays inside the row: exploding words and regrouping them by id would
    shuffle the corpus only to rebuild one vector per row.
    """

    dim: int = 64

    @property
    def name(self) -> str:
        return f"hash-{self.dim}"

    def __call__(self, text: Column) -> Column:
        buckets = _Buckets(self.dim)

        @F.pandas_udf("array<float>")
        def embed(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: hash_vector(t, buckets))

        return embed(text)


def get_embedder(model: str = "hash-64") -> Embedder:
    """Embedder by stored model name, so queries use the space of the corpus."""
    match = re.fullmatch(r"hash-(\d+)", model)
    if not match:
        raise ValueError(f"unsupported embedder {model!r}")
    return HashEmbedder(int(match.group(1)))


def _sentences(text: str | None) -> list[str]:
    return [s.strip() for s in re.split(r"[.!?\n]", text or "") if s.strip()]


def extractive_summary(context: Column, max_tokens: int, dim: int = 64) -> Column:
    """Sentences nearest the centroid of the context, in text order, within the budget."""

    buckets = _Buckets(dim)

    def one(text: str) -> str:
        sentences = _sentences(text)
        if not sentences:
            return ""
        vecs = np.stack([hash_vector(s, buckets) for s in sentences]).astype(np.float64)
        score = np.round(vecs @ vecs.mean(axis=0), 6)
        order = np.lexsort((np.arange(len(sentences)), -score))
        cost = np.array([max(1, (len(s) + 3) // 4) for s in sentences])
        keep = order[np.cumsum(cost[order]) <= max_tokens]
        if len(keep) == 0:
            keep = order[:1]
        return ". ".join(sentences[i] for i in sorted(keep)) + "."

    @F.pandas_udf("string")
    def summarize(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return summarize(context)


def extractive_answer(context: Column, question: Column, dim: int = 64) -> Column:
    """The sentence of the context closest to the question."""

    buckets = _Buckets(dim)

    def one(text: str | None, q: str) -> str:
        sentences = _sentences(text)
        if not sentences:
            return ""
        scores = np.stack([hash_vector(s, buckets) for s in sentences]).astype(np.float64) @ hash_vector(q, buckets)
        return sentences[int(np.argmax(np.round(scores, 6)))]

    @F.pandas_udf("string")
    def answer(texts: pd.Series, questions: pd.Series) -> pd.Series:
        return pd.Series([one(t, q) for t, q in zip(texts, questions)], index=texts.index, dtype=object)

    return answer(context, question)


@dataclass(frozen=True)
class LimitedEmbedder:
    """An embedder that refuses texts of more than ``max_tokens``, as providers do."""

    inner: HashEmbedder
    max_tokens: int = 8191

    @property
    def name(self) -> str:
        return self.inner.name

    def __call__(self, text: Column) -> Column:
        return self.inner(text)

    def checked(self, text: Column) -> Column:
        """``struct<vec, error>``: the vector, or why there is none."""
        error = F.when(tx.tokens_ceil(text) > self.max_tokens, F.lit(f"input length cannot exceed {self.max_tokens} tokens"))
        return F.struct(F.when(error.isNull(), self.inner(F.when(error.isNull(), text))).alias("vec"), error.alias("error"))


def overlap_reranker(question: Column, passage: Column) -> Column:
    """Share of the question's distinct words that the passage contains."""
    q = F.array_distinct(tx.words(F.lower(question)))
    p = tx.words(F.lower(passage))
    return F.size(F.array_intersect(q, p)) / F.greatest(F.size(q), F.lit(1))
