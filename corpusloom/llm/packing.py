"""Best-fit packing of token pieces into sequences by linear grouping.

Lengths above a quarter of a sequence are large.  They are divided, in
order, into groups of about equal cardinality and rounded up to the largest of
their group, which leaves few sizes.  For these the driver picks
configurations (how many of each size share a sequence) from the numbers per
size alone: each time the configuration that fills best around the largest size
left, as often as it fits.  Then Spark puts actual pieces into the places
of their group, and the small pieces go best-fit into what the actual lengths
leave.  The driver only ever sees numbers per length (at most 2048 each).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, freed_shuffles
from corpusloom.operators.ordered import arrange, number_rows
from corpusloom.session import shuffle_width

CAPACITY, GROUPS, SMALL_SHARE = 2048, 512, 4
CACHED = 300_000  # words a worker remembers
_SPECIAL = "<|endoftext|>"


class _SpaceRun(Exception):
    """A space is followed by white space, so the text must not be split there."""


class _Words(dict):
    """Token bytes of `` word`` by word, filled on demand."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise _SpaceRun
        ids = self.encode(" " + word)
        if len(word) < 32 and "\n" not in word:
            if len(self) >= CACHED:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Token ids of a text as little-endian 32-bit bytes, from a byte-level BPE file.

    A text is split at spaces before words, which its pre-tokenizer always
    gives to the word; a text with other runs of white space is encoded whole.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token != _SPECIAL}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(path)
    raw = lambda ids: np.array(ids, "<u4").tobytes()
    words = _Words(lambda s: raw(fast.encode_ordinary(s)))

    def encode(text: str) -> bytes:
        if _SPECIAL in text:
            return raw(slow.encode(text, add_special_tokens=False).ids)
        first, *rest = text.split(" ")
        try:
            return raw(fast.encode_ordinary(first)) + b"".join(map(words.__getitem__, rest))
        except _SpaceRun:
            return raw(fast.encode_ordinary(text))
    return encode


def _pieces(path: str, keep_ids: bool):
    """Pieces of the texts; a third column, if there is one, stands on all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            out = []
            of = []
            for i, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"))):
                raw = encode(text.as_py()) + b"\0\0\0\0"
                n = len(raw) // 4
                at, piece = 0, 0
                while at < n:
                    # The piece that may be short comes first.
                    size = n % CAPACITY if at == 0 and n % CAPACITY else CAPACITY
                    part = raw[4 * at:4 * (at + size)]
                    out.append((doc_id, piece, at, size, zlib.crc32(part), part if keep_ids else None))
                    of.append(i)
                    at, piece = at + size, piece + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            more = batch.schema.names[2:]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)), *(batch.column(c).take(pa.array(of, pa.int64())) for c in more)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "ids", *more])
    return run


def ranked(df: DataFrame, key: str, name: str) -> DataFrame:
    """Position of every row among those of its key, from 0; a key of most rows is spread over many tasks."""
    width = shuffle_width(df.sparkSession)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(width)))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy(F.col(key).alias("_key"), F.col("_salt").alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_key", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(key, "_salt").orderBy("_row")) - 1
    joined = salted.withColumn(name, own).join(offsets, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_part")))
    return joined.withColumn(name, F.col(name) + F.col("_before")).drop("_salt", "_key", "_part", "_before")


def _fill(sizes: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """How many of each size fill ``room`` best, by dynamic programming over reachable sums."""
    take = np.zeros(len(sizes), np.int64)
    by = np.full(room + 1, -1)   # the last size that reached a sum, and from which sum
    come = np.zeros(room + 1, np.int64)
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    for g, size in enumerate(sizes):
        if size > room or not left[g]:
            continue
        used = np.where(reached, 0, -1)
        for _ in range(int(min(left[g], room // size))):
            ready = np.flatnonzero(used[:room + 1 - size] >= 0)
            ready = ready[~reached[ready + size]]
            if not len(ready):
                break
            reached[ready + size], by[ready + size], come[ready + size] = True, g, ready
            used[:] = -1
            used[ready + size] = 1
        if reached[room]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        take[by[at]] += 1
        at = int(come[at])
    return take


def configurations(sizes: np.ndarray, numbers: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Configurations of rounded sizes (descending) and how often each is used, until nothing is left."""
    left, out = numbers.astype(np.int64).copy(), []
    while left.any():
        g = int(np.flatnonzero(left)[0])
        one = np.zeros(len(sizes), np.int64)
        one[g] = 1
        take = one + _fill(sizes, left - one, int(CAPACITY - sizes[g]))
        some = take > 0
        times = int((left[some] // take[some]).min())
        out.append((take, times))
        left -= take * times
    return out


class Places:
    """Where the pieces of a group go: ranks to sequences, from the configurations."""

    def __init__(self, numbers: dict[int, int]):
        small = CAPACITY // SMALL_SHARE
        lengths = np.array(sorted((n for n in numbers if n > small), reverse=True), np.int64)
        counts = np.array([numbers[n] for n in lengths], np.int64)
        self.group_of = np.full(CAPACITY + 1, -1, np.int64)  # -1: small
        tops, sums = [], []
        if len(lengths):
            before = np.cumsum(counts) - counts
            bucket = np.where(lengths == CAPACITY, -1, before * GROUPS // max(1, counts.sum()))
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            self.group_of[lengths] = np.cumsum(np.isin(np.arange(len(lengths)), starts)) - 1
            tops, sums = lengths[starts], np.add.reduceat(counts, starts)
        chosen = configurations(np.array(tops, np.int64), np.array(sums, np.int64))
        self.sequences = sum(t for _, t in chosen)
        self.tables: list[tuple[np.ndarray, ...]] = []
        bases = np.cumsum([0, *[t for _, t in chosen]])
        for g in range(len(tops)):
            use = [(int(take[g]), int(times), int(base)) for (take, times), base in zip(chosen, bases) if take[g]]
            width = np.array([c for c, _, _ in use], np.int64)
            begin = np.cumsum([0, *[c * t for c, t, _ in use]])[:-1]
            self.tables.append((begin, width, np.array([b for _, _, b in use], np.int64)))


def sequences_of(tables: list[tuple[np.ndarray, ...]], group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    out = np.zeros(len(group), np.int64)
    for g in np.unique(group):
        begin, width, base = tables[g]
        m = group == g
        i = np.searchsorted(begin, rank[m], side="right") - 1
        out[m] = base[i] + (rank[m] - begin[i]) // width[i]
    return out


FRESH = CAPACITY + 1  # class of sequences opened for small pieces


def best_fit(small: dict[int, int], rooms: dict[int, int]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Small pieces, longest first, into the least room that takes them.

    Sequences are intervals of ranks in the class of their first room.  Gives
    moves ``(length, first piece, pieces, class, first sequence)`` and the
    number of sequences opened.
    """
    at: dict[int, list[tuple[int, int, int]]] = {r: [(r, 0, n)] for r, n in rooms.items() if n}
    moves, opened = [], 0
    for size in sorted(small, reverse=True):
        done, count = 0, small[size]
        while done < count:
            room = min((r for r, x in at.items() if r >= size and x), default=None)
            if room is None:
                n = -(-(count - done) // (CAPACITY // size))
                at.setdefault(CAPACITY, []).append((FRESH, opened, opened + n))
                opened += n
                continue
            kind, lo, hi = at[room].pop()
            n = min(count - done, hi - lo)
            if lo + n < hi:
                at[room].append((kind, lo + n, hi))
            moves.append((size, done, n, kind, lo))
            at.setdefault(room - size, []).append((kind, lo, lo + n))
            done += n
    return moves, opened


def _place_large(tables: list[tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = sequences_of(tables, batch.column("grp").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("length"), pa.array(at)], ["_row", "length", "sequence_id"])
    return run


def _place_small(moves: list[tuple[int, int, int, int, int]]):
    by: dict[int, tuple[np.ndarray, ...]] = {}
    for size in {m[0] for m in moves}:
        own = [m for m in moves if m[0] == size]
        by[size] = tuple(np.array([m[i] for m in own], np.int64) for i in (1, 3, 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            kind, place = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                first, kinds, lows = by[int(size)]
                m = length == size
                i = np.searchsorted(first, rank[m], side="right") - 1
                kind[m], place[m] = kinds[i], lows[i] + rank[m] - first[i]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("length"), pa.array(kind), pa.array(place)], ["_row", "length", "kind", "place"])
    return run


def _numbers(df: DataFrame, column: str) -> dict[int, int]:
    with freed_shuffles(df.sparkSession):
        return {r[0]: r[1] for r in df.groupBy(column).count().collect()}  # at most one row a length


def _in_order(packed: DataFrame) -> DataFrame:
    """The same sequences, numbered from 0 in the order of the first place in each."""
    packed = cut(packed)
    firsts = packed.groupBy("sequence_id").agg(F.min("place").alias("_first"))
    with freed_shuffles(packed.sparkSession):
        placed = arrange(firsts, "_first", "sequence_id")
    numbers = number_rows(placed, name="_no").select(F.col("sequence_id").alias("_old"), (F.col("_no") - 1).alias("_new"))
    joined = packed.join(numbers, F.col("sequence_id") == F.col("_old")).withColumn("sequence_id", F.col("_new"))
    return joined.drop("place", "_old", "_new")


def packed_sequences(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", keep_ids: bool = False,
                     place: Column | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``, bytes, if wanted) of every piece.

    A document is its ids and one id 0; a null text is empty and still has
    that id.  Only documents of more than 2048 ids are cut, the shorter piece
    first.  Null ids are kept, repeated rows are packed each, equal lengths
    are placed in the order of the input, other columns are ignored.  With
    ``place``, a string that orders the documents, sequences are numbered from 0
    by the first document that each of them holds.
    """
    ordered = [] if place is None else [place.cast("string").alias("place")]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *ordered)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary" + ", place string" * len(ordered)
    pieces = rows.mapInArrow(_pieces(tokenizer, keep_ids), schema)
    pieces = cut((pieces if keep_ids else pieces.drop("ids")).withColumn("_row", F.monotonically_increasing_id()))
    numbers = _numbers(pieces, "length")
    places = Places(numbers)
    group = F.element_at(F.lit([int(g) for g in places.group_of]), F.col("length").cast("int") + 1)
    keys = pieces.select("_row", "length", group.alias("grp"))
    large = cut(ranked(keys.filter("grp >= 0"), "grp", "rank").select("_row", "length", F.col("grp").cast("long"), F.col("rank").cast("long"))
                .mapInArrow(_place_large(places.tables), "_row long, length long, sequence_id long"))
    rooms = large.groupBy("sequence_id").agg((F.lit(CAPACITY) - F.sum("length")).alias("room")).filter("room > 0")
    rooms = cut(ranked(rooms.withColumnRenamed("sequence_id", "_row"), "room", "spot").select(F.col("_row").alias("of_sequence"), "room", "spot"))
    small = {n: c for n, c in numbers.items() if places.group_of[n] < 0}
    moves, _ = best_fit(small, _numbers(rooms, "room"))
    chosen = ranked(keys.filter("grp < 0"), "length", "rank").select("_row", "length", F.col("rank").cast("long"))
    chosen = cut(chosen.mapInArrow(_place_small(moves), "_row long, length long, kind long, place long"))
    fitted = chosen.join(rooms, (F.col("kind") == F.col("room")) & (F.col("place") == F.col("spot")), "left")
    fresh = F.when(F.col("kind") == FRESH, F.col("place") + places.sequences)
    fitted = fitted.select("_row", "length", F.coalesce(fresh, "of_sequence").alias("sequence_id"))
    together = large.union(fitted)
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = together.select(F.col("_row").alias("_piece"), "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"))
    out = pieces.join(placed, F.col("_row") == F.col("_piece")).drop("_row", "_piece")
    return out if place is None else _in_order(out)
