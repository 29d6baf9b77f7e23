"""Markdown text to sections: one row per heading with its ancestors' path.

A line is a heading when it starts with one to six ``#`` and whitespace and no
code fence is open.  Text before the first heading is a section of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import ordered

# Patterns of a heading line and of a code fence.
HEADING = r"^(#{1,6})[\t-\r\x1c-\x20](.*)$"
FENCE = r"^[\t-\r\x1c-\x20]*```"
LEVELS = 6


def lines_of(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Explode texts into ``line`` rows numbered by ``pos``."""
    return docs.select(*keys, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def _scan(lines: DataFrame, keys: list[str], large: bool, step: str):
    """Running sums and last values, in one window per key or chunk by chunk."""
    def add(df: DataFrame, sums=None, lasts=None) -> DataFrame:
        if large:
            return ordered.running(df, keys, sums=sums, lasts=lasts)
        w = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = [F.sum(c).over(w).alias(k) for k, c in (sums or {}).items()]
        out += [F.last(c, ignorenulls=True).over(w).alias(k) for k, c in (lasts or {}).items()]
        return df.select("*", *out)
    return add


def _path(level: Column) -> Column:
    """Path of the ancestors of a heading of that level, ``/a/b/`` or ``/``."""
    names: list[Column] = []
    for i in range(1, LEVELS):
        here = F.col(f"_h{i}")
        above = [F.coalesce(F.col(f"_h{j}")["at"], F.lit(-1).cast("bigint")) for j in range(1, i)]
        newest = F.greatest(*above) if len(above) > 1 else (above[0] if above else F.lit(-1).cast("bigint"))
        names.append(F.when((level > i) & (here["at"] > newest), here["title"]))
    joined = F.array_join(F.array_compact(F.array(*names)), "/")
    return F.when(joined == "", "/").otherwise(F.concat(F.lit("/"), joined, F.lit("/")))


def sections(lines: DataFrame, keys: list[str], order: list[str] | None = None, *,
             large_groups: bool = False, max_chars: int | None = None) -> DataFrame:
    """``keys..., section_no, header_path, header, level, text`` from line rows.

    ``large_groups=False`` is for documents that came as one row each, so that
    one document's lines fit a task.  With ``large_groups=True`` a document may
    be of any size.  ``max_chars`` drops longer sections before their lines
    are put together.
    """
    order = order or ["pos"]
    if large_groups:
        at, base = "_row", ordered.arrange(lines.select(*keys, *order, "line"), *keys, *order)
    else:
        at, base = "_row", lines.select(*keys, "line", F.col(order[0]).cast("bigint").alias("_row"))
    scan = _scan(lines, keys, large_groups, at)
    fence = F.when(F.col("line").rlike(FENCE), 1).otherwise(0)
    base = scan(base.withColumn("_fence", fence), sums={"_open": F.col("_fence")})
    hashes = F.length(F.regexp_extract("line", HEADING, 1))
    is_heading = (F.col("_fence") == 0) & (F.col("_open") % 2 == 0) & (hashes > 0)
    base = base.withColumn("_level", F.when(is_heading, hashes).otherwise(0))
    mark = F.struct(F.col(at).alias("at"), F.regexp_extract("line", HEADING, 2).alias("title"))
    base = scan(
        base,
        sums={"section_no": F.when(F.col("_level") > 0, 1).otherwise(0)},
        lasts={f"_h{i}": F.when(F.col("_level") == i, mark) for i in range(1, LEVELS)},
    )
    heading = F.col("_level") > 0
    own = F.regexp_extract("line", HEADING, 2)
    rows = base.select(
        *keys, "section_no", at,
        F.when(heading, F.concat(F.repeat(F.lit("#"), F.col("_level")), F.lit(" "), own)).otherwise(F.col("line")).alias("line"),
        F.when(heading, F.col("_level")).alias("level"),
        F.when(heading, own).alias("header"),
        F.when(heading, _path(F.col("_level"))).alias("header_path"),
    )
    group = [*keys, "section_no"]
    if max_chars is not None:
        # Whitespace at either end can only shorten a section by what the sum
        # of non-blank lines leaves out, so this bound never drops a short one.
        solid = rows.groupBy(*group).agg(
            F.sum(F.length(tx.strip(F.col("line")))).alias("_len")).where(F.col("_len") <= max_chars)
        rows = rows.join(solid.select(*group), group, "left_semi")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "line"))), lambda s: s["line"]), "\n")
    out = rows.groupBy(*group).agg(
        tx.strip(joined).alias("text"),
        F.max("level").alias("level"), F.max("header").alias("header"),
        F.coalesce(F.max("header_path"), F.lit("/")).alias("header_path"),
    ).where(F.length("text") > 0)
    return out.where(F.length("text") <= max_chars) if max_chars is not None else out
