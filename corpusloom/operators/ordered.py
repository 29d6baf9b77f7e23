"""Order-dependent operators that never bring one key, or everything, to one task.

``arrange`` range-partitions rows by their order and writes them out once.
Everything after that is a window inside a chunk plus a carry between chunks;
the carry table has one row per (key, chunk), so a key that holds most of the
rows is still spread over all chunks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage, shuffle_width


def arrange(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows in the given order, with ``_row`` (increasing) and ``_chunk``."""
    n = shuffle_width(df.sparkSession)
    placed = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    return cut_lineage(placed).withColumn("_chunk", F.shiftright("_row", 33).cast("int"))


def _before(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def number_rows(arranged: DataFrame, keys: list[str] = (), name: str = "row_no") -> DataFrame:
    """Position of each row within its key, from 1."""
    keys = list(keys)
    stats = arranged.groupBy(*keys, "_chunk").agg(F.min("_row").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    offsets = stats.select(
        *keys, "_chunk", "_lo", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)).alias("_off")
    )
    return (
        arranged.join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.col("_off") + F.col("_row") - F.col("_lo") + 1)
        .drop("_lo", "_off")
    )


def running(
    arranged: DataFrame,
    keys: list[str] = (),
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running sums, last non-NULL values and values of the row before.

    ``sums`` and ``lasts`` include the current row.  The keys must be a prefix
    of the order given to ``arrange``.
    """
    keys = list(keys)
    sums, lasts, previous = dict(sums or {}), dict(lasts or {}), dict(previous or {})
    here = Window.partitionBy(*keys, "_chunk").orderBy("_row")
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    totals = [F.sum(c).alias(f"_t_{k}") for k, c in sums.items()]
    totals += [F.max_by(c, F.when(c.isNotNull(), F.col("_row"))).alias(f"_t_{k}") for k, c in lasts.items()]
    totals += [F.max_by(F.struct(c.alias("v")), F.col("_row")).alias(f"_t_{k}") for k, c in previous.items()]
    stats = arranged.groupBy(*keys, "_chunk").agg(*totals)
    carried = [F.sum(f"_t_{k}").over(_before(keys)).alias(f"_c_{k}") for k in sums]
    carried += [
        F.last(f"_t_{k}", ignorenulls=True).over(_before(keys)).alias(f"_c_{k}") for k in [*lasts, *previous]
    ]
    carry = stats.select(*keys, "_chunk", *carried)

    local = [F.sum(c).over(upto).alias(f"_l_{k}") for k, c in sums.items()]
    local += [F.last(c, ignorenulls=True).over(upto).alias(f"_l_{k}") for k, c in lasts.items()]
    local += [F.lag(F.struct(c.alias("v"))).over(here).alias(f"_l_{k}") for k, c in previous.items()]
    out = arranged.select("*", *local).join(carry, [*keys, "_chunk"])
    for k in sums:
        out = out.withColumn(k, F.coalesce(F.col(f"_c_{k}"), F.lit(0)) + F.col(f"_l_{k}"))
    for k in lasts:
        out = out.withColumn(k, F.coalesce(f"_l_{k}", f"_c_{k}"))
    for k in previous:
        out = out.withColumn(k, F.coalesce(f"_l_{k}", f"_c_{k}")["v"])
    return out.drop(*[f"_{p}_{k}" for p in "cl" for k in [*sums, *lasts, *previous]])


def renumber_by_first_appearance(df: DataFrame, label: str, *order: str, name: str = "new_label") -> DataFrame:
    """Labels become 1, 2, 3, ... in the order in which they first occur."""
    firsts = df.groupBy(label).agg(F.min(F.struct(*order)).alias("_first"))
    ranks = number_rows(arrange(firsts, "_first"), name=name).select(label, name)
    return df.join(ranks, label)


def contiguous_groups(df: DataFrame, label: str, *order: str, keys: list[str] = ()) -> DataFrame:
    """Gaps and islands: ``group_no`` (from 1) of each run of equal labels."""
    keys = list(keys)
    placed = arrange(df, *keys, *order)
    flagged = running(placed, keys, previous={"_prev": F.col(label)})
    starts = F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col(label)), 1).otherwise(0)
    flagged = flagged.withColumn("_start", starts)
    return running(flagged, keys, sums={"group_no": F.col("_start")}).drop("_prev", "_start", "_row", "_chunk")


def concat_parts(
    df: DataFrame, keys: list[str], order: list[str], text: Column, sep: str, rows_per_part: int = 1000
) -> DataFrame:
    """Ordered concatenation per key: ``keys, part, text, n_rows``, a part per ``rows_per_part`` rows, from 0.

    The parts of a key joined by ``sep`` are its whole text; no row grows with
    the size of the group.
    """
    placed = arrange(df.select(*keys, *order, text.alias("_text")), *keys, *order)
    numbered = number_rows(placed, keys).withColumn(
        "part", F.floor((F.col("row_no") - 1) / rows_per_part).cast("bigint")
    )
    return numbered.groupBy(*keys, "part").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("row_no", "_text"))), lambda s: s["_text"]), sep
        ).alias("text"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def concat_whole(df: DataFrame, keys: list[str], order: list[str], text: Column, sep: str, rows_per_part: int = 1000) -> DataFrame:
    """Ordered concatenation per key in one text: ``keys, text, n_rows``.

    Ordered parts of ``rows_per_part`` rows are joined first, all keys side by
    side; only the join of a key's parts is one task, as its text is one cell.
    Null keys are a key; null texts are passed over, as by ``string_agg``.
    """
    keyed = df.withColumns({k: F.struct(F.col(k).alias("key")) for k in keys})  # a struct is never null, so null keys are joined too
    parts = concat_parts(keyed.where(text.isNotNull()), keys, order, text, sep, rows_per_part)
    listed = F.array_sort(F.collect_list(F.struct("part", "text")))
    whole = parts.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda s: s["text"]), sep).alias("text"))
    counted = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.join(whole, keys, "left").select(*[F.col(k)["key"].alias(k) for k in keys], "text", "n_rows")
