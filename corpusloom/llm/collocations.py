"""Phrases that are more than their parts, mined per language.

Frequent n-grams are found level by level.  A scan counts the n-grams whose two
shorter runs may be frequent, sends the counts to hash partitions, and each
partition folds them into one Misra-Gries summary, in a stream.  What a summary
gives up per n-gram stays below the threshold, so no frequent n-gram is lost;
the next scan learns of the survivors from a bit table of fixed size, which may
let too many through but none too few.  A last scan counts the survivors
exactly, by their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, drop_cut, first_row, freed_shuffles
from corpusloom.llm.runs import Slice, byte_class, slices
from corpusloom.llm.tokens import buffers, mix, powers, span_hashes
from corpusloom.operators.ordered import arrange, number_rows
from corpusloom.session import shuffle_width

LEAST_COUNT = 10
MAX_WORDS = 3
PER_LANGUAGE = 2000
COVERED = (50, 100)  # a phrase is dropped when a longer one has this share of its occurrences
NO_LANGUAGE = "und"

PIECE_ENDS = byte_class(*map(ord, ".,;:!?"), (0x0A, 0x0D))
WORD = ~(PIECE_ENDS | byte_class(0x20, 0x09))
SLOTS_PER_KEY = 16    # of the bit table, as long as it is smaller than
BITS = 1 << 27        # slots: 16 MB
HELD = 1 << 19        # distinct n-grams a scan task holds before it passes them on
PART_BYTES = 24 << 20  # text bytes per hash partition
CAPACITY = 1 << 18    # counters a summary starts with


class MisraGries:
    """Counts of 64-bit keys in bounded memory.

    A counter is at most ``lost`` too small and never too large.  When there are
    more counters than ``capacity``, the amount of the first one beyond it is
    taken from all; if that would bring ``lost`` to the threshold, the capacity
    doubles instead.  So it always exceeds the mass divided by the threshold
    where it has to, and every key that occurs ``threshold`` times survives.
    Summaries merge: counters and losses add up.
    """

    def __init__(self, threshold: int, capacity: int = CAPACITY):
        self.threshold, self.capacity, self.lost = threshold, max(1, capacity), 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._more: list[tuple[np.ndarray, np.ndarray]] = []
        self._waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._more.append((keys, counts))
        self._waiting += len(keys)
        if self._waiting > max(self.capacity, len(self.keys)):
            self._fold()

    def merge(self, other: MisraGries) -> None:
        other._fold()
        self.lost += other.lost
        if self.lost >= self.threshold:
            raise ValueError("summaries that are merged must have lost less than the threshold together")
        self.add(other.keys, other.counts)

    def _fold(self) -> None:
        self.keys, self.counts = summed([(self.keys, self.counts), *self._more])
        self._more, self._waiting = [], 0
        while (over := len(self.keys) - self.capacity) > 0:
            least = int(np.partition(self.counts, over - 1)[over - 1])
            if self.lost + least >= self.threshold:
                self.capacity *= 2
                continue
            self.lost += least
            held = self.counts > least
            self.keys, self.counts = self.keys[held], self.counts[held] - least

    def frequent(self) -> np.ndarray:
        """All keys that may occur ``threshold`` times."""
        self._fold()
        return self.keys[self.counts + self.lost >= self.threshold]


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(counts[order], new)


class Grams:
    """Keys of the n-grams of one slice, and which of them pass the bit tables."""

    def __init__(self, part: Slice, language: np.ndarray):
        self.part = part
        self.language = language[part.row]
        self.words = span_hashes(part.data, part.start, part.end)

    def keys(self, n: int, at: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for j, p in enumerate(powers(n)):
            h += self.words[at + j] * p
        return mix(h ^ mix(self.language[at] + np.uint64(n)))

    def passing(self, n: int, shorter: np.ndarray | None) -> np.ndarray:
        """First words of the n-grams that end in this slice and whose two shorter runs are in the table of those."""
        at = self.part.first_words(n)
        for j in range(2 if n > 1 else 0):
            at = at[hit(shorter, self.keys(n - 1, at + j))]
        return at


def hit(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(len(table) * 8 - 1)
    return (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def _grams(batch: pa.RecordBatch, back: int) -> Iterator[Grams]:
    names = batch.column(1)
    distinct = names.dictionary_encode()
    data, offsets = buffers(distinct.dictionary)
    code = span_hashes(data, offsets[:-1], offsets[1:])
    language = code[distinct.indices.to_numpy(zero_copy_only=False)]
    for part in slices(batch.column(0), WORD, PIECE_ENDS, back):
        if len(part.start):
            yield Grams(part, language)


def _frequent(texts: DataFrame, n: int, shorter: Broadcast | None, threshold: int, parts: int) -> DataFrame:
    """``key`` of every n-gram that may occur ``threshold`` times; ``shorter`` is the table of the (n-1)-grams."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def passed_on() -> pa.RecordBatch:
            keys, counts = summed(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

        for batch in batches:
            for grams in _grams(batch, n - 1):
                keys, counts = np.unique(grams.keys(n, grams.passing(n, shorter and shorter.value)), return_counts=True)
                held.append((keys.view(np.int64), counts.astype(np.int64)))
                size += len(keys)
                if size > HELD:
                    yield passed_on()
                    size = 0
        if held:
            yield passed_on()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = MisraGries(threshold)
        for batch in batches:
            summary.add(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(summary.frequent())], ["key"])

    counted = texts.mapInArrow(count, "key long, n long")
    return cut(counted.repartition(parts, "key").mapInArrow(fold, "key long"))


def bit_table(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """A table of bits that has the slots of all keys; at most ``bits`` of them (a power of two), whatever the number of keys."""
    wanted = 64
    while wanted < min(bits, keys.count() * SLOTS_PER_KEY):
        wanted *= 2
    slot = F.col("key").bitwiseAND(F.lit(wanted - 1)).alias("slot")
    cell = keys.select(slot).selectExpr("shiftright(slot, 6) as cell", "shiftleft(1L, cast(slot & 63 as int)) as bit")
    with freed_shuffles(keys.sparkSession):
        found = cell.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(wanted // 64, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out.view(np.uint8)


def _exact_counts(texts: DataFrame, tables: list[Broadcast]) -> DataFrame:
    """``lang, phrase, words, n`` of all n-grams in the tables; the row without a phrase has all words of the language."""
    most = len(tables)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1)
            for grams in _grams(batch, most - 1):
                part = grams.part
                rows, n_words = np.unique(part.row[part.carried:], return_counts=True)
                out = [pa.RecordBatch.from_arrays([names.take(pa.array(rows)), pa.nulls(len(rows), pa.string()),
                                                   pa.array(np.zeros(len(rows), np.int32)), pa.array(n_words.astype(np.int64))], _COUNTED)]
                for n in range(1, most + 1):
                    at = grams.passing(n, tables[n - 2].value if n > 1 else None)
                    keys = grams.keys(n, at)
                    keep = hit(tables[n - 1].value, keys)
                    _, first, counts = np.unique(keys[keep], return_index=True, return_counts=True)
                    at = at[keep][first]
                    if len(at):
                        out.append(pa.RecordBatch.from_arrays(
                            [names.take(pa.array(part.row[at])), spans(part.data, part.start[at], part.end[at + n - 1]),
                             pa.array(np.full(len(at), n, np.int32)), pa.array(counts.astype(np.int64))], _COUNTED))
                yield from out

    return texts.mapInArrow(count, "lang string, phrase string, words int, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


_COUNTED = ["lang", "phrase", "words", "n"]


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """``data[start:end]`` as strings."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(int(offsets[-1])) + np.repeat(start - offsets[:-1], size)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at]))


def _words(phrase: str, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def collocations(docs: DataFrame, *, least_count: int = LEAST_COUNT, max_words: int = MAX_WORDS, per_language: int = PER_LANGUAGE,
                 covered: tuple[int, int] = COVERED, bits: int = BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of 2 to ``max_words`` words of each language.

    Texts are split into pieces and words after lower-casing A-Z.  ``a`` is the
    number of a phrase's occurrences, at least ``least_count``; a cut after k
    words has ``l`` and ``r`` occurrences of its parts and the score
    floor(10^6 a a / (l r)); the cut with the lowest score counts, ties to the
    smallest k.  Phrases that a longer one covers are dropped.  ``n`` is the
    number of the language's words.  Ranks go by score, then ``a``, both
    descending, then by the phrase's bytes.  A null text is empty, a null
    language is ``und``; repeated rows count each.  An empty table gives no
    rows.  Columns besides ``text`` and ``lang`` are not read, so their names
    do not matter.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"))
    size = first_row(texts.agg(F.sum(F.octet_length("text"))))[0] or 0
    parts = max(shuffle_width(spark), size // PART_BYTES + 1)
    tables: list[Broadcast] = []
    for n in range(1, max_words + 1):
        found = _frequent(texts, n, tables[-1] if tables else None, least_count, parts)
        tables.append(spark.sparkContext.broadcast(bit_table(found, bits)))  # at most ``bits`` bits
        drop_cut(found)
    counted = cut(_exact_counts(texts, tables).filter((F.col("n") >= least_count) | (F.col("words") == 0)))
    return _ranked(counted, least_count, per_language, covered)


def _ranked(counted: DataFrame, least_count: int, per_language: int, covered: tuple[int, int]) -> DataFrame:
    held = counted.filter((F.col("words") > 0) & (F.col("n") >= least_count))
    part = held.select("lang", "phrase", F.col("n").alias("f"))
    phrases = held.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", _words("phrase", 1, F.col("k"))).withColumn("right", _words("phrase", F.col("k") + 1, F.col("words") - F.col("k")))
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    whole = lambda c: F.col(c).cast("decimal(14,0)")  # noqa: E731 - products within 38 digits
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", (F.lit(1_000_000).cast("decimal(7,0)") * (whole("a") * whole("a"))).alias("_x"), (whole("l") * whole("r")).alias("_y"))
    lowest = F.min(F.struct(F.expr("_x div _y").alias("score"), "k", "l", "r")).alias("c")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest)
    # The runs inside each longer phrase, and the most frequent phrase that holds them.
    longer = phrases.filter("words > 2").select("lang", "a", "words", "phrase", F.explode(F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> struct(i as i, m as m))))")).alias("w"))
    inner = longer.select("lang", _words("phrase", F.col("w.i"), F.col("w.m")).alias("phrase"), "a")
    over = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_over"))
    left = scored.join(over, ["lang", "phrase"], "left").filter(F.col("_over").isNull() | (covered[1] * F.col("_over") < covered[0] * F.col("a")))
    left = left.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    # Ranked over ranges of the order, so no language is sorted whole in one task.
    placed = arrange(left, "lang", F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = number_rows(placed, ["lang"], "rank").filter(F.col("rank") <= per_language)
    totals = counted.filter("words = 0").select("lang", "n")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH p AS (SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang, unnest(string_split_regex({_LOW}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
    g AS (SELECT lang, m AS words, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
        FROM w, range(1, {MAX_WORDS + 1}) s(m) WHERE len(ws) >= m),
    f AS (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
    c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1 AND f >= {LEAST_COUNT}),
    cuts AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp FROM c, range(1, {MAX_WORDS}) s(k) WHERE k < words),
    s AS (SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
        FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
    best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS c FROM s),
    inside AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS over
        FROM c, range(2, {MAX_WORDS}) s(m), range(1, {MAX_WORDS}) t(i) WHERE m < words AND i + m - 1 <= words GROUP BY ALL),
    kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE c = 1 AND (over IS NULL OR {COVERED[1]} * over < {COVERED[0]} * a)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {PER_LANGUAGE}
"""
