"""Exact duplicates by distributed radix partitioning on the bytes of the texts, first bytes first.

A level reads the next block of bytes of every text that still shares its group
with another one: the block is the digit, and rows of equal group and digit form
the next group.  A group of one row is done, and so is a group whose block is
not full, because its texts have ended.  Groups and digits are compared as they
are; no digest stands for a text.  Counts are pre-aggregated and the table of
groups has one row for each, so a group may hold any part of the rows: the join
with it can be split (skew join).  Only texts that still share a group go on.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, drop_cut, freed_shuffles

FIRST_BLOCK = 64
GROWTH = 8
LARGEST_BLOCK = 1 << 20


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _split(counted: DataFrame, rows: DataFrame, width: int, level: int, number: bool = False) -> DataFrame:
    """One level: ``rows(doc_id, text_sha256, row, group, digit, rest)`` with their new group, or what is known of a finished one.

    ``counted(group, digit, doc_id)`` are the same rows.  ``done`` names a finished group of several rows.
    """
    groups = counted.groupBy("group", "digit").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id")).filter("n > 1")
    groups = cut(groups.withColumn("next", F.monotonically_increasing_id()))
    named = groups.select(F.col("group").alias("g"), F.col("digit").alias("d"), "n", "keep_id", "next").hint("shuffle_hash")
    found = rows.join(named, (F.col("group") == F.col("g")) & (F.col("digit") == F.col("d")), "left")
    alone, more = F.col("n").isNull(), F.col("n").isNotNull() & (F.octet_length("digit") == width)
    out = cut(found.select(
        "doc_id", "text_sha256", (F.monotonically_increasing_id() if number else F.col("row")).alias("row"), more.alias("more"),
        F.when(more, F.col("next")).alias("group"), F.when(more, F.col("rest")).alias("rest"),
        F.when(~more & ~alone, F.struct(F.lit(level).alias("level"), F.col("next").alias("group"))).alias("done"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size")))
    drop_cut(groups)
    return out


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row.

    Texts are equal when they are identical after lower-casing A-Z; null counts
    as empty.  Of equal texts the row with the largest id stays (null ids are
    the smallest); of several rows with that id one of them, so exactly one row
    of a group is kept.  An empty table gives no rows.  Columns besides
    ``doc_id`` and ``text`` are not read, so their names do not matter.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The first bytes are within as many characters, so only those are folded to count them.
    first = F.substring(lower_ascii(F.substring("text", 1, FIRST_BLOCK)).cast("binary"), 1, FIRST_BLOCK).alias("digit")
    start = F.lit(0).cast("long").alias("group")
    whole = rows.select("doc_id", lower_ascii(F.col("text")).alias("text"))
    whole = whole.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), start, F.col("text").cast("binary").alias("text"))
    whole = whole.select("doc_id", "text_sha256", "group", F.substring("text", 1, FIRST_BLOCK).alias("digit"),
                         F.expr(f"substring(text, {FIRST_BLOCK + 1})").alias("rest"))
    split = _split(rows.select("doc_id", start, first), whole, FIRST_BLOCK, 0, number=True)
    width, level, finished = FIRST_BLOCK, 0, []
    while True:
        finished.append(split.filter("not more").select("doc_id", "text_sha256", "row", "done", "keep_id", "group_size"))
        active = split.filter("more")
        if active.isEmpty():
            break
        width, level = min(width * GROWTH, LARGEST_BLOCK), level + 1
        digit = F.substring("rest", 1, width).alias("digit")
        split = _split(active.select("doc_id", "group", digit),
                       active.select("doc_id", "text_sha256", "row", "group", digit, F.expr(f"substring(rest, {width + 1})").alias("rest")), width, level)
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    largest = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # Rows that repeat the largest id of their group, where there are any.
    with freed_shuffles(docs.sparkSession):
        again = cut(out.filter(largest & F.col("done").isNotNull()).groupBy("done").agg(F.min("row").alias("stays"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    again = again.select(F.col("done").alias("_done"), "stays")
    out = out.join(again, F.col("done") == F.col("_done"), "left")
    kept = largest & (F.col("stays").isNull() | (F.col("stays") == F.col("row")))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


_TEXT = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH t AS (SELECT doc_id, {_TEXT} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""
