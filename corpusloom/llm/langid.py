"""Language identification by string kernels.

Two texts are compared by the blended spectrum kernel: the number of byte
n-grams (1 to 4, hashed to cells) present in both, over the root of the product
of their own numbers.  One-versus-rest kernel ridge regression is solved in
the span of Nyström landmarks, on a bounded sample of labelled rows.  As the
kernel is linear in presence vectors, landmarks and coefficients fold into one
cells-by-languages matrix, and texts are scored by batched matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import tokens as tk
from corpusloom.llm.common import cut, drop_cut, freed_shuffles

ORDERS, CELLS, SLICE_ROWS = 4, 1 << 15, 256
PER_LANGUAGE, LANDMARKS = 1024, 128  # fitting rows a language at most, landmarks in all at least
FITTING_ROWS = 1 << 16               # fitting rows in all, but one a language at least
RIDGE = 1e-4
UNKNOWN = "und"
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[[0x20, *range(0x09, 0x0E)]] = 0x20


def presence(col: pa.Array) -> np.ndarray:
    """``rows x CELLS`` zeros and ones: which n-grams a text has, its ends marked by spaces."""
    data, offsets = tk.buffers(pc.utf8_lower(col))
    rows = len(offsets) - 1
    out = np.zeros(rows * CELLS, np.uint8)
    piece = tk.SLICE
    for a in range(0, len(data), piece):
        b = min(len(data), a + piece + ORDERS - 1)
        raw = _FOLD[data[a:b]]
        row = np.searchsorted(offsets, np.arange(a, b), side="right") - 1 if rows > 1 else np.zeros(b - a, np.int64)
        key = np.zeros(len(raw), np.uint32)
        for n in range(1, ORDERS + 1):
            if len(raw) < n:
                break
            m = len(raw) - n + 1
            key = key[:m] | (raw[n - 1:] << np.uint32(8 * (n - 1)))
            cell = (key * _ODD[n - 1]) >> np.uint32(32 - 15)
            whole = row[:m] == row[n - 1:]
            out[(row[:m] * CELLS + cell)[whole]] = 1
    return out.reshape(rows, CELLS)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # CELLS x languages

    def scores(self, x: np.ndarray) -> np.ndarray:
        size = np.maximum(x.sum(1, dtype=np.int64), 1)
        return (x.astype(np.float32) @ self.weights) / np.sqrt(size)[:, None]


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), SLICE_ROWS):
            part = batch.slice(a, SLICE_ROWS)
            bits = np.packbits(presence(part.column("text")), axis=1)
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("turn"), pa.array([x.tobytes() for x in bits], pa.binary())], ["lang", "turn", "bits"])


def fit(rows: DataFrame) -> Model:
    """Fit on ``doc_id, text, lang``: every language, each with up to 1024 rows chosen by hash.

    With more than 64 languages a language has fewer rows, 65,536 in all.  That
    bound concerns fitting only.  The driver gets presence bits of 4 kB a row.
    """
    spark = rows.sparkSession
    with freed_shuffles(spark):
        counts = cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows")))
        languages = counts.count()
        if not languages:
            return Model([], np.zeros((CELLS, 0), np.float32))
        per = max(1, min(PER_LANGUAGE, FITTING_ROWS // languages))
        # A share of each language, by hash, with about twice the rows wanted (32 at least, so that none is left
        # without a row): no language's rows meet in one task.
        share = F.least(F.lit(1.0), F.lit(float(max(2 * per, 32))) / F.col("_rows"))
        mark = F.xxhash64("doc_id", "text")
        own = rows.join(F.broadcast(counts), "lang").filter(F.pmod(mark, F.lit(1 << 31)) < share * F.lit(float(1 << 31)))  # one row a language
        order = Window.partitionBy("lang").orderBy("_mark", "doc_id")
        own = own.withColumn("_mark", mark).withColumn("turn", F.row_number().over(order))
        got = own.filter(F.col("turn") <= per).select("lang", "turn", "text").mapInArrow(_bits, "lang string, turn int, bits binary").toArrow()
    drop_cut(counts)
    order = np.lexsort((np.array(got.column("lang").to_pylist()), got.column("turn").to_numpy()))
    names, bits = got.column("lang").take(pa.array(order)).to_pylist(), got.column("bits").take(pa.array(order)).to_pylist()
    languages = sorted(set(names))
    unpack = lambda a, b: np.unpackbits(np.frombuffer(b"".join(bits[a:b]), np.uint8).reshape(-1, CELLS // 8), axis=1).astype(np.float32)
    scaled = lambda x: x / np.sqrt(np.maximum(x.sum(1), 1))[:, None]
    marks = scaled(unpack(0, max(LANDMARKS, 2 * len(languages))))  # rows come turn by turn: each language has a landmark
    k_mm = marks @ marks.T
    left, right = RIDGE * len(bits) * k_mm.astype(float), np.zeros((len(marks), len(languages)))
    for a in range(0, len(bits), SLICE_ROWS):
        k = (scaled(unpack(a, a + SLICE_ROWS)) @ marks.T).astype(float)
        y = (np.array(names[a:a + SLICE_ROWS])[:, None] == np.array(languages)).astype(float)
        left += k.T @ k
        right += k.T @ y
    left += 1e-9 * np.trace(left) * np.eye(len(marks))
    return Model(languages, (marks.T @ np.linalg.solve(left, right)).astype(np.float32))


def _predict(model, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*model.value)
        for batch in batches:
            col = batch.column(text)
            letters = pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names, best = np.full(len(col), UNKNOWN, object), np.zeros(len(col))
            for a in range(0, len(col) if m.languages else 0, SLICE_ROWS):
                s = m.scores(presence(col.slice(a, SLICE_ROWS)))
                i = s.argmax(1)
                names[a:a + SLICE_ROWS], best[a:a + SLICE_ROWS] = np.array(m.languages, object)[i], np.clip(s[np.arange(len(s)), i], 0, 1)
            names[~letters], best[~letters] = UNKNOWN, 0.0
            yield batch.append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(best))
    return run


def predict_languages(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), learned from rows where ``train`` is true and ``lang`` not null.

    A text that is null or without a letter is ``und`` with score 0, as are
    all texts when there is nothing to learn from.  Ties go to the language
    first in order.  Null ids, repeated rows and further columns are kept; a
    column already called ``lang_pred`` or ``score`` is replaced.
    """
    rows = docs.filter(F.coalesce(train, F.lit(False)) & F.col(lang).isNotNull()).select(
        F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).cast("string").alias("lang"))
    fitted = fit(rows)
    model = docs.sparkSession.sparkContext.broadcast((fitted.languages, fitted.weights))
    base = docs.drop("lang_pred", "score")
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return base.mapInArrow(_predict(model, text), schema)
