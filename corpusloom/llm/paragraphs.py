"""Repeated paragraphs and passages across documents.

Two kinds of text are compared.  *Paragraphs*, single lines and hard-wrapped
blocks between blank lines, are compared by MinHash banding: those that share
a band are verified by exact Jaccard similarity of their five-word shingles,
and a class is a component of these links.  *Passages* are word windows that
stand in several documents, whatever lines they lie in.  Each window of 12
words that has the least hash among 40 neighbouring windows is a seed, so any
two copies of 51 words share one and no stretch of a copy is farther than 39
words from the next.  The windows that near to a shared seed are then compared -
from seed to seed as one where all copies agree, one by one elsewhere - so a
passage reaches exactly from its first to its last repeated word.  The document
with the smallest id keeps a class or window; in every other document it is a
removal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import tokens as tk
from corpusloom.llm.buckets import bucket_links, members_of, plain_sets
from corpusloom.llm.common import cut, drop_cut, free_name

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 4       # recall 0.995 at similarity 0.8
LINE_WORDS = 12           # shorter lines are not paragraphs
WRAP_CHARS = 120          # a block of which a line is longer is not hard-wrapped: its lines are paragraphs
WINDOW, NEAR = 12, 40     # words of a window, windows of which one is a seed: WINDOW + NEAR - 1 = 51 repeated words are found for certain
THIN = 32                 # of equal seeds in a row about one in so many words stays (periodic text)
_SEEDS = tk.mix(np.arange(1000, 1000 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)

_UNITS = "doc_id long, kind int, pos int, n_words int, start int, length int, body long, bands array<long>"


def _bodies(w: tk.Words, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of the spans of ``n`` words that begin at the words ``first``."""
    if not len(first):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(n) - n
    pos = np.arange(int(n.sum())) - np.repeat(begin, n)
    body = np.add.reduceat(w.hash[pos + np.repeat(first, n)] * tk.powers(int(n.max()))[pos], begin)
    return tk.mix(body ^ n.astype(np.uint64) * tk.BYTE_CODES[9])


def _sliding(v: np.ndarray, n: int, least) -> np.ndarray:
    """``least`` (np.minimum or np.maximum) of every ``n`` neighbours, by their first."""
    out, size = v, 1
    while size < n:
        step = min(size, n - size)
        out = least(out[:-step], out[step:])
        size += step
    return out


def _seeds(w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of the windows that have the least hash among ``NEAR`` neighbours of their text."""
    h, first = tk.windows(w, WINDOW)
    if not len(h):
        return h, first
    row = w.row[first]
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    n = np.diff(np.append(start, len(h)))
    chosen = (h == np.repeat(np.minimum.reduceat(h, start), n)) & np.repeat(n < NEAR, n)
    if len(h) >= NEAR:
        low = _sliding(h, NEAR, np.minimum)
        low[row[NEAR - 1:] != row[:len(low)]] = 0
        none = np.zeros(NEAR - 1, np.uint64)
        chosen |= (h == _sliding(np.concatenate([none, low, none]), NEAR, np.maximum)) & np.repeat(n >= NEAR, n)
    at = np.flatnonzero(chosen)
    # Gaps of at most THIN + NEAR words stay, which windows within NEAR - 1 words of a seed fill.
    same = (h[at][1:] == h[at][:-1]) & (row[at][1:] == row[at][:-1]) & (np.diff(at) <= NEAR)
    chain = np.flatnonzero(np.concatenate([[True], ~same]))
    size = np.diff(np.append(chain, len(at)))
    turn = (at - np.repeat(at[chain], size)) // THIN
    keep = np.concatenate([[True], ~same | (turn[1:] != turn[:-1])])
    keep[chain + size - 1] = True
    return h[at[keep]], first[at[keep]]


def _blocks(w: tk.Words, row: np.ndarray, line: np.ndarray, new: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of the hard-wrapped paragraphs: two lines or more between blank lines, none of them long."""
    begin = np.flatnonzero(np.concatenate([[True], (line[1:] > line[:-1] + 1) | (row[1:] != row[:-1])]))
    lines = np.flatnonzero(new)
    last = np.append(lines[1:], len(row)) - 1
    width = chars[w.end[last]] - chars[w.start[lines]]
    of = np.searchsorted(lines, begin)
    fits = (np.maximum.reduceat(width, of) <= WRAP_CHARS) & (np.diff(np.append(of, len(lines))) > 1)
    return begin[fits], np.diff(np.append(begin, len(row)))[fits]


def _bands(w: tk.Words, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Band keys of lines: MinHash over their shingles."""
    h = np.zeros(len(w.hash), np.uint64)
    count = np.maximum(n - SHINGLE + 1, 0)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    for j, p in enumerate(tk.powers(SHINGLE)):
        h[at] += w.hash[at + j] * p
    h = tk.mix(h[at] ^ np.uint64(SHINGLE))
    keys = np.zeros((len(first), BANDS), np.uint64)
    begin = np.cumsum(count) - count
    for b in range(BANDS):
        for r in range(ROWS):
            least = np.minimum.reduceat(h * _SEEDS[b * ROWS + r], begin)
            keys[:, b] = tk.mix(keys[:, b] * tk.BYTE_CODES[8] + least)
    return keys ^ np.arange(BANDS, dtype=np.uint64) * tk.BYTE_CODES[11]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), 1000):
            col = batch.column("text").slice(a, 1000)
            w = tk.words(col)
            if not len(w.hash):
                continue
            row = w.row
            chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
            line = np.cumsum(w.data == 10)[w.start]
            new = np.concatenate([[True], (line[1:] != line[:-1]) | (row[1:] != row[:-1])])
            lines = np.flatnonzero(new)
            blocks, sizes = _blocks(w, row, line, new, chars)
            first, n = np.concatenate([lines, blocks]), np.concatenate([np.diff(np.append(lines, len(row))), sizes])
            form, keep = np.repeat([0, 2], [len(lines), len(blocks)]), n >= LINE_WORDS
            first, n, form = first[keep], n[keep], form[keep]
            keys = _bands(w, first, n) if len(first) else np.zeros((0, BANDS), np.uint64)
            seed, at = _seeds(w)
            body = np.concatenate([_bodies(w, first, n), seed])
            kind = np.concatenate([form, np.ones(len(seed), int)])
            first, n = np.concatenate([first, at]), np.concatenate([n, np.full(len(seed), WINDOW)])
            last, text_at = first + n - 1, w.offsets[row[first]]
            offsets = np.concatenate([[0], np.cumsum((kind != 1) * BANDS)]).astype(np.int32)
            ints = lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                pc.take(batch.column("doc_id").slice(a, 1000), pa.array(row[first])), ints(kind), ints(first - w.bounds[row[first]]), ints(n),
                ints(chars[w.start[first]] - chars[text_at]), ints(chars[w.end[last]] - chars[w.start[first]]), pa.array(body.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))], names=[x.split()[0] for x in _UNITS.split(", ")])


# A segment is a run of windows near shared seeds that ends where the next seed begins.
_SEGMENTS = "doc_id long, pos int, windows int, body long, head long, tail long"
_WINDOWS = "body long, k int, h long, lo long, hi long, n long"
_ROWS = "doc_id long, start int, length int, n_words int, class_id long, class_size long, keeper_id long"


def _starts(part: pa.RecordBatch, name: str, w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the entries of a list column, and the first words of their rows."""
    row = np.repeat(np.arange(len(part)), pc.list_value_length(part.column(name)).to_numpy(zero_copy_only=False))
    return row, w.bounds[row]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows within ``NEAR - 1`` words of a document's shared seeds, in segments.

    ``body`` stands for all words of a segment, the seed after it included;
    ``head`` is the seed it begins with and ``tail`` the one that follows, where
    there is one.
    """
    for batch in batches:
        for a in range(0, len(batch), 200):
            part = batch.slice(a, 200)
            w = tk.words(part.column("text"))
            h, first = tk.windows(w, WINDOW)
            if not len(h):
                continue
            row, begin = _starts(part, "seeds", w)
            end = w.bounds[row + 1]
            at = begin + part.column("seeds").flatten().to_numpy()
            step = np.bincount(np.clip(at - NEAR + 1, begin, end), minlength=len(w.hash) + 1) - np.bincount(np.clip(at + NEAR, begin, end), minlength=len(w.hash) + 1)
            seed = np.zeros(len(w.hash), bool)
            seed[at] = True
            near, seed = np.cumsum(step)[first] > 0, seed[first]
            after = np.concatenate([[False], near[:-1] & (first[1:] == first[:-1] + 1)])  # follows a near window of its text
            starts = np.flatnonzero(near & (~after | seed))
            n = np.diff(np.append(np.cumsum(near)[starts] - 1, int(near.sum())))
            then = np.minimum(starts + n, len(h) - 1)
            followed = (starts + n < len(h)) & seed[then] & after[then]
            body = tk.mix(_bodies(w, first[starts], n + WINDOW - 1 + followed) ^ tk.BYTE_CODES[followed + 2 * seed[starts]])
            row = w.row[first[starts]]
            long = lambda x, held: pa.array(x.view(np.int64), mask=~held)
            yield pa.RecordBatch.from_arrays([
                pc.take(part.column("doc_id"), pa.array(row)), pa.array((first[starts] - w.bounds[row]).astype(np.int32)), pa.array(n.astype(np.int32)),
                pa.array(body.view(np.int64)), long(h[starts], seed[starts]), long(h[then], followed)], names=[x.split()[0] for x in _SEGMENTS.split(", ")])


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the segments listed for each document."""
    for batch in batches:
        for a in range(0, len(batch), 200):
            part = batch.slice(a, 200)
            w = tk.words(part.column("text"))
            h, first = tk.windows(w, WINDOW)
            row, begin = _starts(part, "of", w)
            of = part.column("of").flatten()
            n = of.field("windows").to_numpy().astype(np.int64)
            start = np.searchsorted(first, begin + of.field("pos").to_numpy())
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            again = lambda name: pa.array(np.repeat(of.field(name).to_numpy(), n))
            yield pa.RecordBatch.from_arrays([again("body"), pa.array(k.astype(np.int32)), pa.array(h[np.repeat(start, n) + k].view(np.int64)),
                                              again("lo"), again("hi"), again("n")], names=[x.split()[0] for x in _WINDOWS.split(", ")])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Code points of the runs of windows listed for each document."""
    for batch in batches:
        for a in range(0, len(batch), 200):
            part = batch.slice(a, 200)
            w = tk.words(part.column("text"))
            row, begin = _starts(part, "of", w)
            of = part.column("of").flatten()
            pos, n = (of.field(c).to_numpy().astype(np.int64) for c in ("pos", "windows"))
            chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
            start, stop = chars[w.start[begin + pos]], chars[w.end[begin + pos + n + WINDOW - 2]]
            ints = lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pc.take(part.column("doc_id"), pa.array(row)), ints(start - chars[w.offsets[row]]), ints(stop - start), ints(n + WINDOW - 1),
                                              *(of.field(c) for c in ("class_id", "class_size", "keeper_id"))], names=[x.split()[0] for x in _ROWS.split(", ")])


def _listed(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("of"))


def _joined(rows: DataFrame, key: str, at: str, same: tuple[str, ...] = ("keeper_id", "class_size")) -> DataFrame:
    """Neighbours ``windows`` apart that agree in ``same`` as one row, with the least of their other values."""
    by = Window.partitionBy(key).orderBy(at)
    lag = lambda c: F.lag(c).over(by)
    follows = F.col(at) <= lag(at) + lag("windows")
    for c in same:
        follows &= F.col(c) == lag(c)
    fresh = rows.withColumn("fresh", (~F.coalesce(follows, F.lit(False))).cast("int"))
    runs = fresh.withColumn("run", F.sum("fresh").over(by)).groupBy(key, "run", *same)
    others = [F.min(c).alias(c) for c in ("class_id", "class_size", "keeper_id") if c not in same]
    return runs.agg(F.min(at).alias(at), (F.max(F.col(at) + F.col("windows")) - F.min(at)).alias("windows"), *others).drop("run")


def _passages(texts: DataFrame, seeds: DataFrame, removals: bool = False) -> DataFrame:
    """Runs of windows that stand in two documents or more; ``seeds`` are the shared ones.

    Copies mostly agree in whole segments.  A segment whose end seeds never
    occur without it is compared as one; of the others each different one is
    compared window by window once, for all documents that have it.
    ``removals``: only runs that are to go, whatever their keepers and numbers
    of copies.  In near copies these change at every edit of any of them, so
    such runs are as many as copies times edits; removals are not cut there.
    """
    segments = cut(texts.join(_listed(seeds, "pos").select("doc_id", F.transform("of", lambda x: x["pos"]).alias("seeds")), "doc_id").mapInArrow(_segments, _SEGMENTS))
    classes = cut(segments.groupBy("body").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"), F.first("head").alias("head"),
                                               F.first("tail").alias("tail"), F.min(F.struct("doc_id", "pos", "windows")).alias("at")))
    heads = cut(classes.filter("head is not null").groupBy("head").agg(F.sum("n").alias("all")))
    as_tail = heads.select(F.col("head").alias("tail"), F.col("all").alias("all_tail"))
    closed = (F.col("n") == F.coalesce("all", F.lit(0))) & (F.col("n") == F.coalesce("all_tail", F.lit(0)))
    classes = cut(classes.join(heads, "head", "left").join(as_tail, "tail", "left").select("body", "lo", "hi", "n", "at", closed.alias("closed")))
    single = classes.filter("not closed").select("at.doc_id", "at.pos", "at.windows", "body", "lo", "hi", "n")
    windows = cut(texts.join(_listed(single, "pos", "windows", "body", "lo", "hi", "n"), "doc_id").mapInArrow(_single_windows, _WINDOWS))
    named = cut(windows.groupBy("h").agg(F.min("lo").alias("keeper_id"), F.max("hi").alias("last"), F.sum("n").alias("class_size")).filter("keeper_id < last").drop("last"))
    shared = windows.select("body", "k", "h").join(named, "h").select("body", "k", F.lit(1).alias("windows"), "keeper_id", "class_size", F.col("h").alias("class_id"))
    inside = cut(_joined(shared, "body", "k", ("keeper_id",) if removals else ("keeper_id", "class_size")))
    whole = classes.filter("closed and lo < hi").select("body", F.lit(0).alias("k"), F.col("at.windows").alias("windows"), F.col("lo").alias("keeper_id"),
                                                        F.col("n").alias("class_size"), F.col("body").alias("class_id"))
    runs = inside.select(*whole.columns).unionByName(whole)
    found = segments.select("doc_id", "pos", "body").join(runs, "body").select(
        "doc_id", (F.col("pos") + F.col("k")).alias("pos"), "windows", "keeper_id", "class_size", "class_id")
    found = cut(_joined(found.filter("doc_id <> keeper_id"), "doc_id", "pos", ()) if removals else _joined(found, "doc_id", "pos"))
    for done in (segments, classes, heads, windows, named, inside):
        drop_cut(done)
    # Each run carries its class through the text it lies in, so runs are not matched with their places afterwards.
    places = texts.join(_listed(found, "pos", "windows", "class_id", "class_size", "keeper_id"), "doc_id").mapInArrow(_placed, _ROWS)
    return places.select("doc_id", F.lit("passage").alias("kind"), "start", "length", "n_words",
                         "class_id", "class_size", "keeper_id", (F.col("doc_id") != F.col("keeper_id")).alias("removed"))


def repeated_paragraphs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Paragraphs and passages that stand in two documents or more.

    ``doc_id, kind (line, block or passage), start, length (code points),
    n_words, class_id, class_size, keeper_id, removed``.  Only documents with
    such text have rows.  A passage of 51 words or more is always found and
    covered as a whole; one of 12 to 50 words when a shared seed is near.  Its
    row ends where the keeper or the number of copies changes, so rows of one
    passage overlap by 11 words.  Repeats inside one document alone, lines and
    blocks of fewer than 12 words, texts that are null or without words and
    rows with a null id yield none.  Rows with one id are one document (of
    several texts the greatest counts); other columns are ignored.
    """
    lines, texts, seeds = _lines(docs, text, doc_id)
    return lines.unionByName(_passages(texts, seeds))


def removed_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, start, length`` of all that ``repeated_paragraphs`` removes; neighbouring and overlapping passages are one."""
    lines, texts, seeds = _lines(docs, text, doc_id)
    return lines.unionByName(_passages(texts, seeds, removals=True)).filter("removed").select("doc_id", "start", "length")


def _lines(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repeated lines and blocks, the texts in which passages are looked for, and their shared seeds."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    rows = _one_text(rows)
    units = cut(rows.mapInArrow(_units, _UNITS))
    lines = units.filter("kind <> 1")
    members = members_of(lines.select(F.col("body").alias("id"), F.explode("bands").alias("band")).distinct())
    wanted = members.select(F.col("id").alias("body")).distinct()
    shown = cut(lines.join(wanted, "body", "left_semi").groupBy("body").agg(F.min(F.struct("doc_id", "start", "length")).alias("at")).select(F.col("body").alias("id"), "at.*"))
    seeds = units.filter("kind = 1").select("doc_id", "pos", "body")
    common = seeds.groupBy("body").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("body")
    seeds = cut(seeds.join(cut(common), "body", "left_semi").select("doc_id", "pos").distinct())
    # Only documents with a shared seed or a paragraph to compare are read again.
    needed = cut(seeds.select("doc_id").union(shown.select("doc_id")).distinct())
    texts = cut(rows.join(needed, "doc_id", "left_semi"))
    of_line = F.expr("substring(text, start + 1, length)").alias("text")
    sentences = cut(shown.join(texts, "doc_id").select("id", of_line))
    roots = bucket_links(members, sentences, plain_sets(SHINGLE), SIMILARITY)
    bodies = lines.groupBy("body").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    named = bodies.join(roots.withColumnRenamed("node", "body"), "body", "left").filter("lo < hi or root is not null")
    named = cut(named.select("body", F.coalesce("root", "body").alias("class_id"), "lo", "hi", "n"))
    classes = named.groupBy("class_id").agg(F.min("lo").alias("keeper_id"), F.max("hi").alias("hi"), F.sum("n").alias("class_size")).filter("keeper_id < hi")
    named = named.join(classes.drop("hi"), "class_id").select("body", "class_id", "class_size", "keeper_id")
    found = cut(lines.drop("bands").join(named, "body").select(
        "doc_id", F.when(F.col("kind") == 0, "line").otherwise("block").alias("kind"), "start", "length", "n_words",
        "class_id", "class_size", "keeper_id", (F.col("doc_id") != F.col("keeper_id")).alias("removed")))
    for done in (members, sentences, shown, units):
        drop_cut(done)
    return found, texts, seeds


def _shared_ids(rows: DataFrame) -> DataFrame | None:
    """``doc_id, text`` of the ids that several rows have: the greatest of their texts.  None when there is none."""
    again = cut(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    if again.isEmpty():
        return None
    return cut(rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text")))


def _one_text(rows: DataFrame) -> DataFrame:
    """Rows that share an id are one document."""
    one = _shared_ids(rows)
    return rows if one is None else rows.join(one, "doc_id", "left_anti").unionByName(one)


def _erase(batches: Iterator[pa.RecordBatch], spans: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, removed in zip(batch.column("text").to_pylist(), batch.column(spans).to_pylist()):
            if removed and text is not None:
                pieces, at = [], 0
                for s in sorted(removed, key=lambda s: s["start"]):
                    if s["start"] > at:
                        pieces.append(text[at:s["start"]])
                    at = max(at, s["start"] + s["length"])
                text = "".join([*pieces, text[at:]])
            out.append(text)
        i = batch.schema.get_field_index("text")
        yield batch.set_column(i, batch.schema.field(i), pa.array(out, batch.schema.field(i).type)).drop_columns([spans])


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their removals (``n_chars`` counted anew); a document that loses all its words goes.

    Documents without removals, null and empty texts among them, stay as they
    are, and so do rows whose text is not the one that stands for their id.
    """
    own, spans, main = (free_name(docs, c) for c in ("id_", "spans_", "main_"))
    found = removed_spans(docs).groupBy(F.col("doc_id").alias(own)).agg(F.collect_list(F.struct("start", "length")).alias(spans))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    several = _shared_ids(rows)
    if several is not None:
        found = found.join(several.select(F.col("doc_id").alias(own), F.xxhash64("text").alias(main)), own, "left")
    else:
        found = found.withColumn(main, F.lit(None).cast("long"))
    of_main = F.col(main).isNull() | (F.col(main) == F.xxhash64(docs["text"].cast("string")))
    joined = cut(docs.join(found, (docs["doc_id"] == F.col(own)) & of_main, "left").drop(own, main))
    erased = joined.filter(F.col(spans).isNotNull()).mapInArrow(partial(_erase, spans=spans), docs.schema)
    if "n_chars" in docs.columns:
        erased = erased.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return joined.filter(F.col(spans).isNull()).drop(spans).union(erased.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")))
