"""Importance resampling of documents towards a target text (hashed n-gram features).

One scan counts the features of all documents and of the target by bucket, a
second one weighs every document.  Each scan normalises a text once and keeps
its running CRCs; the CRC of any n-gram comes from two of them.  Only one
number per bucket reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import freed_shuffles
from corpusloom.llm.crc import POLYNOMIAL, RunningCrc
from corpusloom.llm.runs import byte_class, slices
from corpusloom.operators.ordered import arrange, number_rows

WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
BUCKETS = 10_000
MAX_WORDS = 1
LEAST_WORDS = 20
SHARE = (10, 100)
SEED = "2024"


def _features(col: pa.ChunkedArray, max_words: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: row and bucket of every n-gram, and the rows of the new words."""
    for part in slices(col, WORD, back=max_words - 1):
        if not len(part.start):
            continue
        crc = RunningCrc(part.data)
        for n in range(1, max_words + 1):
            at = part.first_words(n)
            bucket = crc.between(part.start[at], part.end[at + n - 1]) % np.uint32(buckets)
            yield part.row[at], bucket.astype(np.int64), part.row[at] if n == 1 else np.zeros(0, np.int64)


def bucket_counts(texts: DataFrame, text: Column, max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: features of all texts by bucket; at most ``buckets`` rows leave a task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket, _ in _features(batch.column(0), max_words, buckets):
                total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    parts = texts.select(text.cast("string").alias("t")).mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of each bucket: floor(1000 ln) of the target's smoothed share over the source's."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    with freed_shuffles(source.sparkSession):
        found = both.groupBy("bucket").agg(F.sum("s"), F.sum("t")).toPandas().to_numpy(np.int64).reshape(-1, 3)
    s, t = np.zeros(buckets, np.float64), np.zeros(buckets, np.float64)
    s[found[:, 0]], t[found[:, 0]] = found[:, 1], found[:, 2]
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def document_weights(docs: DataFrame, gains: np.ndarray, max_words: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""
    buckets = len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for row, bucket, new in _features(batch.column(1), max_words, buckets):
                words += np.bincount(new, minlength=n)
                features += np.bincount(row, minlength=n)
                np.add.at(weight, row, gains[bucket])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (words, features, weight))],
                                             ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, fixed by the id; a null id has the noise of an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, *, max_words: int = MAX_WORDS, buckets: int = BUCKETS,
              least_words: int = LEAST_WORDS, share: tuple[int, int] = SHARE, seed: str = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank, n_words`` of every row of ``docs``.

    Features are runs of 1 to ``max_words`` words; ``weight`` is the sum of
    their buckets' gains, ``score`` adds the noise.  Of the N rows of at least
    ``least_words`` words the ``share`` (numerator, denominator) with the
    highest scores is drawn and ranked from 1, ties to the smaller id (a null
    id last, then more features first); other rows have a null rank.  A null
    or empty text has no feature and weight 0.  Repeated rows are rows of
    their own.  An empty table gives no rows; an empty target is uniform.
    Columns besides ``doc_id`` and ``text`` are not read, so their names do
    not matter.
    """
    gains = bucket_gains(bucket_counts(docs, F.col("text"), max_words, buckets), bucket_counts(target, F.col("text"), max_words, buckets), buckets)
    scored = document_weights(docs, gains, max_words).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    drawable = F.col("n_words") >= least_words
    with freed_shuffles(docs.sparkSession):
        placed = arrange(scored, (~drawable).alias("_short"), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"))
        n = placed.filter(drawable).count()
    ranked = number_rows(placed, name="_no")
    drawn = drawable & (F.col("_no") <= n * share[0] // share[1])
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("_no")).cast("long").alias("rank"), "n_words")


# DuckDB's form, for features of one word: the CRC-32 of each distinct word by a byte table.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH steps AS (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: xor(c >> 1, {POLYNOMIAL} * (c & 1))) AS v FROM range(256) r(i)),
    bytes AS (SELECT list(v ORDER BY i) AS tab FROM steps),
    d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
    dw AS (SELECT doc_id, unnest(ws) AS w FROM d), bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
    vocabulary AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
    hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS b FROM vocabulary, bytes),
    s AS (SELECT b, count(*) AS n FROM dw JOIN hashed USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM bw JOIN hashed USING (w) GROUP BY b),
    total AS (SELECT (SELECT count(*) FROM dw) AS s, (SELECT count(*) FROM bw) AS t),
    gains AS (SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (total.s + {BUCKETS}) / ((s.n + 1)::DOUBLE * (total.t + {BUCKETS}))))::BIGINT AS g
        FROM s LEFT JOIN t USING (b), total),
    weights AS (SELECT doc_id, sum(g)::BIGINT AS w FROM dw JOIN hashed USING (w) JOIN gains USING (b) GROUP BY doc_id),
    scored AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weights.w, 0) AS weight, coalesce(weights.w, 0)
        + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
        FROM d LEFT JOIN weights USING (doc_id)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS no,
        count(*) FILTER (WHERE n_features >= {LEAST_WORDS}) OVER () AS drawable FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND no <= {SHARE[0]} * drawable // {SHARE[1]} THEN no END AS rank,
    n_features AS n_words FROM placed
"""
