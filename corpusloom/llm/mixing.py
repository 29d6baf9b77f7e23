"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source's texts, in the order of the MD5 of their ids, are one stream that is
cut into blocks of equal length.  With a weight of ``p`` parts in a period of
``h`` slots, block ``j`` may start at slot ``floor(j h / p)`` and must be placed
before slot ``ceil((j + 1) h / p)``.  At every slot the released block with the
earliest deadline is placed (ties: source name), which always meets all
deadlines, so up to any slot a source deviates from its weight by less than one
block.  The schedule repeats every period, so one period is computed, from
numbers per source alone; a source that has ended leaves its slots empty.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import free_name

PERIOD = 1000         # parts that are dealt out among the sources
BLOCK_CHARS = 65_536  # length of a block
SOURCES = 1000        # more sources than this are an error: their schedule is one row
ROWS_PER_BUCKET = 20_000


def target_parts(amounts: DataFrame) -> DataFrame:
    """``source, parts`` from ``source, amount``: weights go with the square root of the amount, one part at least."""
    total = F.sum(F.sqrt("amount"))
    return amounts.crossJoin(amounts.agg(total.alias("_total"))).select(  # one row
        "source", F.greatest(F.lit(1), F.floor(F.lit(PERIOD) * F.sqrt("amount") / F.col("_total") + 0.5)).cast("long").alias("parts"))


def period_slots(parts: DataFrame) -> DataFrame:
    """``source, parts, period, slots``: the slots of each source in one period, by earliest deadline first."""
    one = parts.agg(F.array_sort(F.collect_list(F.struct("source", "parts"))).alias("s"), F.sum("parts").alias("h"))
    bounded = F.when(F.size("s") <= SOURCES, F.col("s")).otherwise(F.raise_error(F.lit(f"more than {SOURCES} sources")))
    one = one.select(bounded.alias("s"), "h")
    p = lambda i: F.get("s", i)["parts"]

    def choose(c, t):
        """Index of the released source with the earliest deadline, from the numbers placed so far."""
        released = lambda n, i: (n < p(i)) & (F.floor(n * F.col("h") / p(i)) <= t)
        due = lambda n, i: F.struct(F.ceil((n + 1) * F.col("h") / p(i)).alias("d"), i.alias("i"))
        return F.array_min(F.transform(c, lambda n, i: F.when(released(n, i), due(n, i))))["i"]

    def step(state, t):
        pick = choose(state["c"], t)
        return F.transform(F.array(pick), lambda k: F.struct(
            F.transform(state["c"], lambda n, i: n + F.when(i == k, 1).otherwise(0).cast("long")).alias("c"),
            F.concat(state["order"], F.array(k)).alias("order")))[0]

    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("c"), F.expr("array()").cast("array<int>").alias("order"))
    order = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("h") - 1), start, step)["order"]
    placed = one.filter(F.size("s") > 0).select("s", "h", F.posexplode(order).alias("slot", "i"))
    return placed.groupBy(F.get("s", F.col("i"))["source"].alias("source"), F.get("s", F.col("i"))["parts"].alias("parts"), F.col("h").alias("period")).agg(
        F.array_sort(F.collect_list("slot")).alias("slots"))


def schedule(docs: DataFrame, parts: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, place, block, release, deadline, slot`` of every row.

    ``place`` is the text's first character in its source's stream, ``block``
    the block of that character, the other three are slots.  ``parts(source,
    parts)`` sets weights; by default they go with the square root of the
    source's amount.  A null source counts as the empty name; a null or empty
    text takes one character; a null id comes first; repeated rows each take their
    place; other columns are ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
                       F.coalesce(F.md5(F.col(doc_id).cast("long").cast("string").cast("binary")), F.lit("")).alias("_h"),
                       F.greatest(F.lit(1), F.char_length(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("_n"))
    amounts = rows.groupBy("source").agg(F.sum("_n").alias("amount"), F.count(F.lit(1)).alias("rows"))
    weights = period_slots(parts if parts is not None else target_parts(amounts))
    # More digits of the hash make more buckets: a source of most rows is summed up in many tasks.
    digits = amounts.agg(F.greatest(F.lit(1), F.ceil(F.log(16.0, F.greatest(F.sum("rows"), F.lit(1)) / ROWS_PER_BUCKET))).cast("int").alias("_digits"))
    keyed = rows.crossJoin(F.broadcast(digits)).withColumn("_bucket", F.expr("substring(_h, 1, _digits)"))  # one row
    sums = keyed.groupBy("source", "_bucket").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    own = Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id", "_n").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_own", F.coalesce(F.sum("_n").over(own), F.lit(0))).join(carry, ["source", "_bucket"])
    placed = placed.withColumn("place", F.col("_own") + F.col("_carry")).withColumn("block", F.floor(F.col("place") / BLOCK_CHARS))
    j, h, p = F.col("block"), F.col("period"), F.col("parts")
    slot = F.floor(j / p) * h + F.get("slots", (j % p).cast("int"))
    return placed.join(F.broadcast(weights), "source").select(  # at most SOURCES rows of PERIOD + SOURCES slots in all
        "doc_id", "source", "place", "block", F.floor(j * h / p).alias("release"), F.ceil((j + 1) * h / p).alias("deadline"), slot.cast("long").alias("slot"))


def in_schedule_order(docs: DataFrame) -> DataFrame:
    """The documents, all of them, stored in the order of their slots."""
    own, stream, at = (free_name(docs, c) for c in ("id_", "source_", "at_"))
    places = schedule(docs).groupBy(F.col("doc_id").alias(own), F.col("source").alias(stream)).agg(F.min(F.struct("slot", "place")).alias(at))
    same = docs["doc_id"].cast("long").eqNullSafe(places[own]) & (F.coalesce(docs["source"].cast("string"), F.lit("")) == places[stream])
    joined = docs.join(places, same)
    order = [F.col(at)["slot"], F.col(stream), F.col(at)["place"]]
    width = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return joined.repartitionByRange(width, *order).sortWithinPartitions(*order).drop(own, stream, at)

def stored_place(docs: DataFrame) -> Column:
    """A string that orders documents read from files as they were written: part, file, row in the file."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:  # not read from files: the order of the rows
        return F.lpad(F.monotonically_increasing_id().cast("string"), 19, "0")
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    part = F.regexp_extract(name, r"^part-(\d+)", 1)
    return F.concat(F.lpad(part, 10, "0"), name, F.lpad(row.cast("string"), 19, "0"))



SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(md5(doc_id::VARCHAR), '') AS hh,
                            greatest(1, length(coalesce(text, '')))::BIGINT AS n FROM documents),
  m AS (SELECT source, sum(n) AS amount FROM d GROUP BY source),
  q AS (SELECT source, greatest(1, floor({PERIOD} * sqrt(amount) / (SELECT sum(sqrt(amount)) FROM m) + 0.5))::BIGINT AS parts FROM m),
  a AS (SELECT list(source ORDER BY source) AS names, list(parts ORDER BY source) AS ps, sum(parts)::BIGINT AS h, count(*) AS k FROM q),
  e(t, c, pick) AS (
    SELECT 0::BIGINT, list_transform(ps, lambda x: 0::BIGINT), NULL::BIGINT FROM a
    UNION ALL
    SELECT t + 1, list_transform(c, lambda x, i: x + (i = b)::BIGINT), b FROM (
      SELECT t, c, list_min(list_filter(list_transform(range(1, k + 1), lambda i: CASE WHEN c[i] < ps[i] AND (c[i] * h) // ps[i] <= t
               THEN {{'d': ((c[i] + 1) * h + ps[i] - 1) // ps[i], 'i': i}} END), lambda x: x IS NOT NULL)).i AS b
      FROM e, a WHERE t < h)),
  slots AS (SELECT names[pick] AS source, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM e, a WHERE pick IS NOT NULL),
  w AS (SELECT source, parts, (SELECT h FROM a) AS h FROM q),
  p AS (SELECT doc_id, source, coalesce(sum(n) OVER (PARTITION BY source ORDER BY hh, doc_id NULLS FIRST, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM d),
  b AS (SELECT *, place // {BLOCK_CHARS} AS block FROM p JOIN w USING (source))
SELECT doc_id, b.source AS source, place, block, (block * h) // parts AS release, ((block + 1) * h + parts - 1) // parts AS deadline,
       (block // parts) * h + slots.slot AS slot
FROM b JOIN slots ON slots.source = b.source AND slots.nth = block % parts
"""
