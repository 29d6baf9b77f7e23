"""Scans of node, vector, docstore and tree tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions import text as tx
from corpusloom.functions import vectors as vx

NODE_COLUMNS = ("id", "fname", "header_path", "title", "ts_ms", "text")


def spread_scan(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet scan with at least one partition per core.

    For heavy work per row on few or small files.  A scan with enough splits,
    the usual case on a cluster, is left as it is.  Filters and column
    selections still reach the files.
    """
    scan = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def node_scan(nodes: DataFrame) -> DataFrame:
    """The six node columns plus ``words``."""
    return nodes.select(*NODE_COLUMNS, tx.word_count(F.col("text")).alias("words"))


def vector_scan(vectors: DataFrame, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """``id, dim, embedding`` with the vector as ARRAY<FLOAT>."""
    v = vx.to_float_vector(F.col(vec))
    return vectors.select(F.col(id_col).alias("id"), F.size(v).alias("dim"), v.alias("embedding"))


def nodes_from_store(rows: DataFrame) -> DataFrame:
    """Node rows from store rows ``id, document, metadata map`` with fallback names."""
    def first(*names: str, default: str):
        found = [F.when(F.col("metadata")[n] != "", F.col("metadata")[n]) for n in names]
        return F.coalesce(*found, F.lit(default))

    m = F.col("metadata")
    return rows.select(
        "id", first("fname", "file", default="").alias("fname"),
        first("header_path", "date", default="/").alias("header_path"),
        F.coalesce(m["title"], F.lit("")).alias("title"),
        F.coalesce(m["ts_ms"], m["timestamp"]).cast("bigint").alias("ts_ms"),
        F.coalesce("document", F.lit("")).alias("text"),
        tx.word_count(F.col("document")).alias("words"),
    )


def key_values(table: DataFrame, key: str, value: str) -> DataFrame:
    return table.select(F.col(key).alias("key"), F.col(value).alias("value"))


def docstore_and_index(spark: SparkSession, docstore: str | None, index: str) -> tuple[DataFrame | None, DataFrame]:
    """Optional docstore table and the index table, by name, as key and value."""
    docs = key_values(spark.table(docstore), "key", "value") if docstore else None
    return docs, key_values(spark.table(index), "key", "value")


def flat_docstore(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Docstore rows ``id, text, metadata`` and the empty edge table of a flat tree."""
    docs = nodes.select("id", "text", F.struct(
        F.col("header_path"), F.col("fname").alias("file"), F.col("ts_ms").alias("timestamp")).alias("metadata"))
    return docs, nodes.sparkSession.createDataFrame([], schemas.EDGE)


def read_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Saved tree as nodes and edges, with a check of their columns."""
    nodes = spark.read.parquet(f"{path}/tree_nodes")
    edges = spark.read.parquet(f"{path}/tree_edges")
    schemas.require(nodes, schemas.TREE_NODE, "tree nodes")
    schemas.require(edges, schemas.TREE_EDGE, "tree edges")
    return nodes, edges


def write_tree(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    if nodes.isEmpty():
        raise ValueError("there is no tree to save")
    nodes.write.mode("overwrite").parquet(f"{path}/tree_nodes")
    edges.write.mode("overwrite").parquet(f"{path}/tree_edges")
