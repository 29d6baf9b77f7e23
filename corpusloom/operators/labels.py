"""Operators over cluster labels: sizes, centroids, merging, naming, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import vectors as vx
from corpusloom.operators import filters, ordered, similarity
from corpusloom.session import cut_lineage


def sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))


def tokens_per_cluster(df: DataFrame, cluster: str = "cluster", text: str = "text") -> DataFrame:
    return df.groupBy(cluster).agg(F.sum(tx.tokens_ceil(F.col(text))).alias("tokens"))


def centroids(df: DataFrame, cluster: str = "cluster", vec: str = "embedding", renormalize: bool = True) -> DataFrame:
    """Mean of the unit vectors per cluster, scaled to unit length again.

    Averages are taken per dimension, so they combine before the shuffle and a
    cluster of any size arrives as ``dim`` numbers per task.
    """
    cells = df.select(cluster, F.posexplode(vx.normalize_l2(F.col(vec))).alias("i", "x"))
    means = cells.groupBy(cluster, "i").agg(F.avg("x").alias("x"))
    rows = F.array_sort(F.collect_list(F.struct("i", "x")))
    mean = F.transform(rows, lambda s: s["x"])
    out = means.groupBy(cluster).agg(mean.alias("centroid"))
    return out.withColumn("centroid", vx.normalize_l2(F.col("centroid"))) if renormalize else out


def merge_small(df: DataFrame, cluster: str = "cluster", vec: str = "embedding",
                min_size: int = filters.MIN_CLUSTER_SIZE) -> DataFrame:
    """Relabel clusters under ``min_size`` to the large cluster with the nearest centroid."""
    counted = sizes(df, cluster).join(centroids(df, cluster, vec), cluster)
    counted = cut_lineage(counted)
    small = counted.where(F.col("n") < min_size)
    big = counted.where(F.col("n") >= min_size)
    target = similarity.top_matches(
        small, big, 1, query=(cluster, "centroid"), item=(cluster, "centroid"), metric="inner_product"
    ).select(F.col("q_id").alias(cluster), F.col("id").alias("_target"))
    return df.join(target, cluster, "left").withColumn(
        cluster, F.coalesce("_target", cluster)).drop("_target").select(*df.columns)


def members(df: DataFrame, cluster: str = "cluster", item: str = "id", order: list[str] | None = None) -> DataFrame:
    """Cluster members with their position in the cluster, one row each."""
    order = order or [item]
    placed = ordered.arrange(df.select(cluster, item, *[o for o in order if o != item]), cluster, *order)
    return ordered.number_rows(placed, [cluster], "pos").select(cluster, "pos", item)


def in_first_appearance_order(df: DataFrame, cluster: str, *order: str) -> DataFrame:
    """``cluster_rank`` by first appearance and ``pos`` inside the cluster."""
    ranked = ordered.renumber_by_first_appearance(df, cluster, *order, name="cluster_rank")
    placed = ordered.arrange(ranked, "cluster_rank", *order)
    return ordered.number_rows(placed, ["cluster_rank"], "pos").drop("_row", "_chunk")


def by_size(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Cluster sizes with ``cluster_rank``: largest first, then by label."""
    placed = ordered.arrange(sizes(df, cluster), F.desc("n"), F.asc(cluster))
    return ordered.number_rows(placed, name="cluster_rank").select(cluster, "n", "cluster_rank")


def polish(df: DataFrame, summarize=None, max_tokens: int = 150, cluster: str = "cluster",
           order: list[str] = ("id",), rows_per_part: int = 1000) -> DataFrame:
    """The texts of each cluster in order, joined whole: ``cluster, text, n_rows``.

    With a summariser, one summary per cluster instead: the texts are joined in
    parts of ``rows_per_part`` rows, the parts are summarised, then the summaries
    of ``rows_per_part`` parts at a time, until one is left, and no row grows
    with a cluster.
    """
    sep = "\n\n"
    if summarize is None:
        return ordered.concat_whole(df, [cluster], list(order), F.col("text"), sep, rows_per_part)
    parts = ordered.concat_parts(df, [cluster], list(order), F.col("text"), sep, rows_per_part)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda s: s["text"]), sep)
    out = None
    while True:
        parts = cut_lineage(parts.withColumn("text", summarize(F.col("text"), max_tokens)))
        whole = parts.join(parts.groupBy(cluster).agg(F.max("part").alias("_last")), cluster)
        done = whole.where("_last = 0").select(cluster, "text", "n_rows")
        out = done if out is None else out.unionByName(done)
        rest = whole.where("_last > 0")
        if rest.isEmpty():
            return out
        grouped = rest.groupBy(cluster, F.floor(F.col("part") / rows_per_part).alias("_part"))
        parts = cut_lineage(grouped.agg(joined.alias("text"), F.sum("n_rows").alias("n_rows")).withColumnRenamed("_part", "part"))


def stub_titles(df: DataFrame, cluster: str = "cluster", order: list[str] = ("id",), chars: int = 50) -> DataFrame:
    """``[Cluster c] first characters...`` of the cluster's joined texts.

    Each further row adds at least its line break, so ``chars + 1`` rows always
    fill the title; only those are joined, each cut to what can show.
    """
    w = Window.partitionBy(cluster).orderBy(*order)
    head = df.select(cluster, *order, tx.prefix(F.col("text"), chars).alias("_t")).withColumn(
        "_rn", F.row_number().over(w)).where(F.col("_rn") <= chars + 1)
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_t"))), lambda s: s["_t"]), "\n")
    return head.groupBy(cluster).agg(
        F.concat(F.lit("[Cluster "), F.col(cluster).cast("string"), F.lit("] "), tx.prefix(joined, chars), F.lit("...")
                 ).alias("title"))


def top_terms(df: DataFrame, k: int = 5, cluster: str = "cluster", text: str = "text") -> DataFrame:
    """Highest TF-IDF terms per cluster; a cluster is the document of the statistics."""
    terms = df.select(cluster, F.explode(tx.words(F.lower(F.col(text)))).alias("term"))
    tf = terms.groupBy(cluster, "term").agg(F.count(F.lit(1)).alias("tf"))
    n = df.select(cluster).distinct().agg(F.count(F.lit(1)).alias("n_clusters"))
    df_ = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    score = F.round(F.col("tf") * F.ln((1 + F.col("n_clusters")) / (1 + F.col("df"))), 6) + F.lit(0.0)
    scored = tf.join(df_, "term").crossJoin(F.broadcast(n)).select(  # one row
        cluster, "term", "tf", score.alias("score"))
    w = Window.partitionBy(cluster).orderBy(F.desc("score"), F.asc("term"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def attach(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Labels and order positions joined by key, not by row position."""
    return df.join(labels, key)


def equal_vectors_agree(df: DataFrame, label: str, vec: str = "embedding") -> DataFrame:
    """Distinct vectors whose copies carry more than one label (should be none)."""
    return df.groupBy(vec).agg(F.count_distinct(label).alias("n_labels")).where("n_labels > 1")


def preview_rows(df: DataFrame, label: str, *order: str, header: str = "header_path", width: int = 100) -> DataFrame:
    """Cluster listing in leaf order: a heading per contiguous group, then one row per node."""
    groups = ordered.contiguous_groups(df, label, *order)
    head = groups.groupBy("group_no", label).agg(F.count(F.lit(1)).alias("n")).select(
        "group_no", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("pos"),
        F.format_string("## Cluster %s (n=%d)", F.col(label).cast("string"), F.col("n")).alias("line"))
    meta = F.coalesce(F.col(header).cast("string"), F.lit("—"))
    padded = F.when(F.length(meta) < 40, F.rpad(meta, 40, " ")).otherwise(meta)
    body = groups.select(
        "group_no", F.lit(1).alias("kind"), F.col(order[0]).cast("bigint").alias("pos"),
        F.concat(padded, F.lit(" | "), tx.shorten(F.col("text"), width)).alias("line"))
    return head.unionByName(body)
