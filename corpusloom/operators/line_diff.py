"""Line differences of two versions of many texts, found by anchors.

Lines that occur once on both sides are candidates for anchors; the longest run
of them that rises on both sides is kept, and the gaps between anchors are
compared in the same way until nothing is unique any more.  Then equal lines at
the beginning and at the end of a gap are matched.  What is left has changed, so
an inserted line is one change and not a shift of all later lines.

Two versions of up to ``LONG`` characters together are compared inside their row;
only changed lines leave it.  Longer ones become line rows, and Python only sees
the places of the anchors of one gap.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import ordered
from corpusloom.session import cut_lineage

# Two versions of more characters together are compared as line rows.
LONG = 4 << 20
EDITS = 4096             # changed lines per batch, and
EDIT_CHARS = 4 << 20     # about as many of their characters


def rising_run(values: np.ndarray) -> np.ndarray:
    """Indices of the longest strictly increasing subsequence."""
    tails: list[int] = []   # smallest last value of a run of each length
    last: list[int] = []    # its index
    before = np.full(len(values), -1, np.int64)
    for i, v in enumerate(values.tolist()):
        n = bisect_left(tails, v)
        before[i] = last[n - 1] if n else -1
        tails[n:n + 1], last[n:n + 1] = [v], [i]
    out, at = [], last[-1] if last else -1
    while at >= 0:
        out.append(at)
        at = int(before[at])
    return np.array(out[::-1], np.int64)


def _anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("a")
    return pdf.iloc[rising_run(pdf["b"].to_numpy())][["_text", "a", "b"]]


def _single(lines: list[str], start: int, end: int) -> dict[str, int]:
    """Place of every line that occurs once between ``start`` and ``end``, in order."""
    once, often = {}, set()
    for i in range(start, end):
        x = lines[i]
        if x in once:
            del once[x]
            often.add(x)
        elif x not in often:
            once[x] = i
    return once


def _changed(a: list[str], b: list[str]) -> Iterator[tuple[int | None, int | None]]:
    """Places of the lines that differ, side by side within a gap: the steps of ``_line_rows`` for one text."""
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        if a0 < a1 and b0 < b1:
            right = _single(b, b0, b1)
            both = [(i, right[x]) for x, i in _single(a, a0, a1).items() if x in right]
            if both:
                for i, j in (both[k] for k in rising_run(np.array([j for _, j in both]))):
                    gaps.append((a0, i, b0, j))
                    a0, b0 = i + 1, j + 1
                gaps.append((a0, a1, b0, b1))
                continue
            n = min(a1 - a0, b1 - b0)
            first = next((k for k in range(n) if a[a0 + k] != b[b0 + k]), n)
            last = next((k for k in range(n - first) if a[a1 - 1 - k] != b[b1 - 1 - k]), n - first)
            if first or last:
                gaps.append((a0 + first, a1 - last, b0 + first, b1 - last))
                continue
        yield from zip_longest(range(a0, a1), range(b0, b1))


def _row_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The changed lines of the rows ``_key, old, new``."""
    held: list[tuple] = []
    chars, fields = 0, None

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), fields)], schema=fields)
        held.clear()
        return made

    for rows in batches:
        fields = pa.schema([rows.schema.field(0), ("old_no", pa.int32()), ("new_no", pa.int32()), ("old_line", pa.string()), ("new_line", pa.string())])
        for key, old, new in zip(*rows.columns):
            key = key.as_py()
            a, b = ([] if t is None else t.split("\n") for t in (old.as_py(), new.as_py()))
            for i, j in _changed(a, b):
                held.append((key, i, j, None if i is None else a[i], None if j is None else b[j]))
                chars += len(held[-1][3] or "") + len(held[-1][4] or "")
                if len(held) >= EDITS or chars >= EDIT_CHARS:
                    yield batch()
                    chars = 0
    if held:
        yield batch()


def _lines(texts: DataFrame, column: str, place: str) -> DataFrame:
    rows = texts.where(F.col(column).isNotNull()).select("_text", F.posexplode(F.split(column, "\n")).alias(place, "line"))
    return rows.withColumn("gap", F.lit(0).cast("bigint"))


def _once(lines: DataFrame, place: str) -> DataFrame:
    return lines.groupBy("_text", "gap", "line").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias(place)).where("_n = 1").drop("_n")


def _open(lines: DataFrame, matched: DataFrame, place: str) -> DataFrame:
    """Lines without a match, with the number of matches before them in ``gap``."""
    marked = lines.drop("gap").join(matched.select("_text", place, F.lit(1).alias("_hit")), ["_text", place], "left")
    placed = ordered.arrange(marked, "_text", place)
    counted = ordered.running(placed, ["_text"], sums={"gap": F.coalesce("_hit", F.lit(0)).cast("bigint")})
    return cut_lineage(counted.where("_hit is null").select("_text", place, "line", "gap"))


def _ranked(lines: DataFrame, place: str, backwards: bool) -> DataFrame:
    """``k``: place inside the gap, from 1, from its beginning or end."""
    order = F.col(place) * (-1 if backwards else 1)
    placed = ordered.arrange(lines.withColumn("_o", order), "_text", "gap", "_o")
    return ordered.number_rows(placed, ["_text", "gap"], "k").drop("_row", "_chunk", "_o")


def _edges(old: DataFrame, new: DataFrame, backwards: bool) -> DataFrame:
    """Equal lines that follow each other from the beginning (or end) of a gap."""
    both = _ranked(old, "a", backwards).join(
        _ranked(new, "b", backwards).withColumnRenamed("line", "_line"), ["_text", "gap", "k"])
    both = cut_lineage(both.withColumn("same", F.col("line") == F.col("_line")).select("_text", "gap", "k", "a", "b", "same"))
    stop = both.groupBy("_text", "gap").agg(F.min(F.when(~F.col("same"), F.col("k"))).alias("_stop"))
    return both.join(stop, ["_text", "gap"]).where(F.col("_stop").isNull() | (F.col("k") < F.col("_stop"))).select("_text", "a", "b")


def line_edits(texts: DataFrame, key: str = "id", old: str = "old", new: str = "new", long: int = LONG) -> DataFrame:
    """``key, old_no, new_no, old_line, new_line`` of the lines that differ, numbered from 0.

    A line without a counterpart has null on the other side; the changed lines
    of a gap are put side by side in order.  A null text has no lines.
    """
    rows = texts.select(F.col(key).alias("_key"), F.col(old).alias("old"), F.col(new).alias("new")).where(~F.col("old").eqNullSafe(F.col("new")))
    beyond = F.coalesce(F.length("old"), F.lit(0)) + F.coalesce(F.length("new"), F.lit(0)) > long
    out = f"_key {rows.schema['_key'].dataType.simpleString()}, old_no int, new_no int, old_line string, new_line string"
    found = rows.where(~beyond).mapInArrow(lambda batches: _row_edits(batches), out).withColumnRenamed("_key", key)
    rest = rows.where(beyond)
    return found if rest.isEmpty() else found.unionByName(_line_rows(rest, key))


def _line_rows(rows: DataFrame, key: str) -> DataFrame:
    """The same for texts of any length, as line rows."""
    # Texts are told apart by their rows, so keys may repeat.
    rows = cut_lineage(rows.withColumn("_text", F.monotonically_increasing_id()))
    a, b = cut_lineage(_lines(rows, "old", "a")), cut_lineage(_lines(rows, "new", "b"))
    all_a, all_b, matched = a, b, None

    def keep(found: DataFrame) -> bool:
        nonlocal a, b, matched
        found = cut_lineage(found)
        if found.isEmpty():
            return False
        matched = found if matched is None else matched.unionByName(found)
        a, b = _open(all_a, matched, "a"), _open(all_b, matched, "b")
        return True

    def by_anchors() -> bool:
        return keep(_once(a, "a").join(_once(b, "b"), ["_text", "gap", "line"]).groupBy("_text", "gap").applyInPandas(
            lambda pdf: _anchors(pdf), "_text bigint, a int, b int"))

    progress = True
    while progress:
        while by_anchors():
            pass
        first = keep(_edges(a, b, False))
        last = keep(_edges(a, b, True))
        progress = first or last
    left = _ranked(a, "a", False).select("_text", "gap", "k", F.col("a").alias("old_no"), F.col("line").alias("old_line"))
    right = _ranked(b, "b", False).select("_text", "gap", "k", F.col("b").alias("new_no"), F.col("line").alias("new_line"))
    out = left.join(right, ["_text", "gap", "k"], "full_outer").join(rows.select("_text", "_key"), "_text")
    return out.select(F.col("_key").alias(key), "old_no", "new_no", "old_line", "new_line")
