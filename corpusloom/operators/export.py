"""Markdown reports as ordered block rows, and their text sinks.

A report is a table of ``block`` rows with sort columns.  Writing it sorts by
range, so a report of any size is a folder of text files in order; ``single``
makes one file and is for reports whose row count was checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import labels
from corpusloom.session import shuffle_width

# Separators and headings of the exports.
SEPARATOR = "\n\n"
CLUSTER_HEADING = "# Cluster %s (%d)"
CLUSTER_HEADING_NODES = "# Cluster %s (%d nodes)"
SINGLE_FILE_ROWS = 100_000


def note_block(include_metadata: bool, template: str = tx.NOTE_TEMPLATE) -> Column:
    body = F.coalesce(F.col("text"), F.lit(""))
    if not include_metadata:
        return body
    return tx.section_block(tx.header_or_default(F.col("header_path")), body, template)


def flat_blocks(nodes: DataFrame, order: str = "id", ascending: bool = True, include_metadata: bool = True,
                template: str = tx.NOTE_TEMPLATE) -> DataFrame:
    """``sort_key, id, block`` of a flat export."""
    key = F.col(order)
    out = nodes.select(key.alias("sort_key"), F.col("id"), note_block(include_metadata, template).alias("block"))
    return out if ascending else out.withColumn("descending", F.lit(True))


def cluster_blocks(nodes: DataFrame, cluster: str = "cluster", titles: DataFrame | None = None,
                   within: str = "id", ascending: bool = True, include_metadata: bool = True,
                   heading: str = CLUSTER_HEADING, template: str = tx.NOTE_TEMPLATE) -> DataFrame:
    """``cluster_rank, kind, sort_key, id, block``: largest cluster first, heading then notes."""
    ranks = labels.by_size(nodes, cluster)
    head = ranks if titles is None else ranks.join(titles, cluster, "left")
    title = F.lit(None).cast("string") if titles is None else F.col("title")
    line = F.format_string(heading, F.col(cluster).cast("string"), F.col("n"))
    line = F.when(F.coalesce(title, F.lit("")) != "", F.concat(line, F.lit(" — "), title)).otherwise(line)
    id_type, key_type = nodes.schema["id"].dataType, nodes.schema[within].dataType
    heads = head.select(
        "cluster_rank", F.lit(0).alias("kind"), F.lit(None).cast(key_type).alias("sort_key"),
        F.lit(None).cast(id_type).alias("id"), line.alias("block"))
    notes = nodes.join(ranks.select(cluster, "cluster_rank"), cluster).select(
        "cluster_rank", F.lit(1).alias("kind"), F.col(within).alias("sort_key"), "id",
        note_block(include_metadata, template).alias("block"))
    out = heads.unionByName(notes)
    return out if ascending else out.withColumn("descending", F.lit(True))


def cluster_blocks_n(nodes: DataFrame, titles: DataFrame | None = None, **options) -> DataFrame:
    """The variant whose heading reads ``(n nodes)``."""
    return cluster_blocks(nodes, titles=titles, heading=CLUSTER_HEADING_NODES, **options)


def _order_of(blocks: DataFrame) -> list[Column]:
    cols = [c for c in ("cluster_rank", "kind") if c in blocks.columns]
    key = F.desc("sort_key") if "descending" in blocks.columns else F.asc("sort_key")
    return [F.col(c) for c in cols] + [key, F.col("id")]


def write_blocks(blocks: DataFrame, path: str, order: list[Column] | None = None, separator: str = SEPARATOR,
                 single: bool = False) -> None:
    """Write block rows in order, each followed by ``separator``.

    With an empty separator every block must end with a line break.
    """
    order = order or _order_of(blocks)
    if single:
        if blocks.limit(SINGLE_FILE_ROWS + 1).count() > SINGLE_FILE_ROWS:
            raise ValueError("report too large for a single file; write it as a folder of parts")
        placed = blocks.orderBy(*order).coalesce(1)
    else:
        placed = blocks.repartitionByRange(shuffle_width(blocks.sparkSession), *order).sortWithinPartitions(*order)
    # The sink ends every row with its separator and takes no empty one; blocks
    # that bring their own line break give it up to the sink.
    block = F.col("block") if separator else F.regexp_replace("block", r"\n\z", "")
    placed.select(block.alias("block")).write.mode("overwrite").option("lineSep", separator or "\n").text(path)


def concat_blocks(nodes: DataFrame, order: str) -> DataFrame:
    """Texts only, in the given order (leaf order of a dendrogram)."""
    return nodes.select(F.col(order).alias("sort_key"), "id", F.col("text").alias("block"))


def write_documents_json(docs: DataFrame, path: str) -> None:
    """Raw dump: one JSON object per document, text first, metadata flattened."""
    rest = [c for c in docs.columns if c != "text"]
    docs.select("text", *rest).write.mode("overwrite").json(path)
