"""Helpers of this subpackage: lineage cuts that free their shuffles, and connected components."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage, shuffle_width

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries inside remove their shuffle files when they end, so only written tables stay on disk."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the table."""
    with freed_shuffles(df.sparkSession):
        return cut_lineage(df)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote, when no later step reads it."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getName().startswith("cut-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def first_row(df: DataFrame):
    """The only row of an aggregate, with the shuffles freed."""
    with freed_shuffles(df.sparkSession):
        return df.first()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)), F.lit(-1))


def parts_for(spark: SparkSession, rows: float, per_part: int) -> int:
    """Number of groups for ``rows`` rows: grows with the data, at least the shuffle width."""
    return max(shuffle_width(spark), int(rows // per_part) + 1)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``node, root`` with the smallest node as root.

    Alternates two star contractions until no edge changes; every step is a
    pre-aggregated group and a join on edges, so a node with very many edges
    is never one row or one task's list.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(edges.select("a", "b").filter("a <> b").distinct())
    while True:
        around = both(edges)
        least = around.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        # Larger neighbours hang on the smallest neighbour.
        large = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        large = cut(large.filter("a <> b").distinct())
        up = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        top = up.groupBy("a").agg(F.min("b").alias("_m"))
        # A node and its smaller neighbours hang on the smallest of them.
        small = up.join(top, "a").select(F.col("b").alias("x"), F.col("_m").alias("b")).withColumnRenamed("x", "a")
        small = cut(small.union(top.select("a", F.col("_m").alias("b"))).filter("a <> b").distinct())
        star = small.select("a", "b").join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty()
        one = small.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
        drop_cut(large)
        drop_cut(edges)
        edges = small
        if star and one:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return cut(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots))
