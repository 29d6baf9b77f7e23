"""Corpus profile, previews and tree depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import filters
from corpusloom.session import cut_lineage


def profile(nodes: DataFrame) -> DataFrame:
    """One row of counts over ``text, title, ts_ms``."""
    n = tx.word_count(F.col("text"))
    ts = tx.truthy(F.col("ts_ms")).cast("bigint")
    return nodes.select(n.alias("w"), F.col("title"), ts.alias("ts")).agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.min("w"), F.lit(0)).alias("min_words"),
        F.coalesce(F.floor(F.percentile("w", 0.5)), F.lit(0)).cast("bigint").alias("median_words"),
        F.coalesce(F.max("w"), F.lit(0)).alias("max_words"),
        F.count_if(F.coalesce(F.col("title"), F.lit("")) != "").alias("titled"),
        tx.iso_date(F.min("ts")).alias("first_day"),
        tx.iso_date(F.max("ts")).alias("last_day"),
    )


def file_totals(records: DataFrame, file: str = "fname", role: str = "role") -> DataFrame:
    """Rows and kept rows per file."""
    return records.groupBy(file).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(filters.by_role(F.col(role))).alias("n_kept")
    )


def rows_per(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def preview(nodes: DataFrame, limit: int = 10, width: int = 100) -> DataFrame:
    """The first nodes by id, shortened for display."""
    head = nodes.orderBy("id").limit(limit)
    return head.select(
        tx.prefix(F.col("id").cast("string"), 8).alias("node_id"),
        tx.word_count(F.col("text")).alias("words"),
        tx.prefix(F.coalesce("title", F.lit("")), 40).alias("title"),
        F.col("ts_ms").alias("timestamp"),
        tx.shorten(F.col("text"), width, tx.PREVIEW_PLACEHOLDER).alias("preview"),
    )


def preview_filtered(
    nodes: DataFrame, keyword: str | None = None, after_ms: int | None = None, limit: int = 50
) -> DataFrame:
    """As ``preview``, of nodes that contain the keyword and are recent enough."""
    if keyword:
        nodes = nodes.where(filters.contains_keyword(F.col("text"), keyword))
    if after_ms is not None:
        nodes = nodes.where(filters.at_or_after(F.col("ts_ms"), after_ms))
    return preview(nodes, limit)


# Doublings per written step.
DOUBLINGS = 3


def child_edges(index: DataFrame, parent: str = "id", children: str = "children") -> DataFrame:
    """Edge rows from a parent table with child-id arrays."""
    return index.select(F.col(parent).alias("parent"), F.posexplode(children).alias("ord", "child")).select(
        "parent", "child", "ord")


def roots(edges: DataFrame) -> DataFrame:
    """Parents that are nobody's child."""
    return edges.select(F.col("parent").alias("node")).distinct().join(
        edges.select(F.col("child").alias("node")), "node", "left_anti")


def depths(edges: DataFrame) -> DataFrame:
    """Longest distance from a root for every node (roots have depth 1).

    In a forest every node jumps to an ancestor and the jump doubles with each
    join, so a chain of n nodes takes log2 n of them.  Where a node has several
    parents, levels are walked from the roots.  Raises when the edges contain a
    cycle: such a node still has an ancestor after as many steps as there are
    nodes.
    """
    pairs = cut_lineage(edges.select("parent", F.col("child").alias("node")).distinct())
    n = pairs.select("node").distinct().count()
    if n < pairs.count():
        return _walked(pairs, n)
    rows = pairs.select("node", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("steps"), F.lit(False).alias("done"))
    covered = 1
    while True:
        for _ in range(DOUBLINGS):
            above = rows.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
            rows = rows.join(above, "up", "left").select(
                "node", F.coalesce("_up", "up").alias("up"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
                F.coalesce("_done", F.lit(True)).alias("done"))
            covered *= 2
        rows = cut_lineage(rows)
        if rows.where("not done").isEmpty():
            break
        if covered > n:
            raise ValueError("the edges contain a cycle")
    return rows.select("node", (F.col("steps") + 1).cast("int").alias("depth")).unionByName(
        roots(edges).withColumn("depth", F.lit(1)))


def _walked(pairs: DataFrame, n: int) -> DataFrame:
    """Depths by levels from the roots; the frontier is written, so the plan does not grow with the depth."""
    frontier = cut_lineage(roots(pairs.withColumnRenamed("node", "child")).withColumn("depth", F.lit(1)))
    levels, parents = [frontier], pairs
    while True:
        step = frontier.join(parents, frontier["node"] == parents["parent"]).select(parents["node"].alias("node")).distinct()
        frontier = cut_lineage(step.withColumn("depth", F.lit(len(levels) + 1)))
        if frontier.isEmpty():
            break
        levels.append(frontier)
        if len(levels) > n + 1:
            raise ValueError("the edges contain a cycle")
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    out = out.groupBy("node").agg(F.max("depth").alias("depth"))
    if not pairs.select("node").join(out, "node", "left_anti").isEmpty():
        raise ValueError("the edges contain a cycle")
    return out


def layer_of(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", "layer")
