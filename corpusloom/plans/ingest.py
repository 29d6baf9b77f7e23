"""Idempotent ingest of day files: records to sections, vectors, nodes and ledger."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions import ids, models
from corpusloom.functions import text as tx
from corpusloom.operators import filters, sectioning, store
from corpusloom.session import cut_lineage
from corpusloom.sources import day_files

ORDER = ["timestamp", "id"]
Parser = Callable[[DataFrame], DataFrame]
Upsert = Callable[[store.Collection, DataFrame], None]


def markdown_sections(records: DataFrame, order: list[str] = ORDER, max_chars: int | None = None) -> DataFrame:
    """Sections of the day Markdown, straight from its block rows.

    A day file may be of any size: its lines are scanned in ordered chunks and
    the day text is never put together.
    """
    blocks = day_files.day_blocks(records, order=order)
    at = ["kind", *order, "pos"]
    lines = blocks.select("fname", "kind", *order, F.posexplode(F.split("block", "\n")).alias("pos", "line"))
    return sectioning.sections(lines, ["fname"], at, large_groups=True, max_chars=max_chars)


def build_nodes(sections: DataFrame, skip_single_line: bool = True, max_chars: int | None = filters.MAX_CHARS) -> DataFrame:
    """Node rows of the sections that pass the guards."""
    kept = sections
    if skip_single_line:
        kept = kept.where(filters.multi_line(F.col("text")))
    if max_chars:
        kept = kept.where(filters.not_too_long(tx.strip(F.col("text")), max_chars))
    ts = F.lit(None).cast("bigint")
    uid = ids.stable_uid(F.col("text"), F.col("header_path"), F.col("fname"), ts)
    return kept.select(uid.alias("id"), "fname", F.coalesce("header_path", F.lit("/")).alias("header_path"),
                       F.lit("").alias("title"), ts.alias("ts_ms"), "text")


def ledger_rows(files: DataFrame, nodes: DataFrame, now_ms: int) -> DataFrame:
    """One ledger row per file, also for files without nodes."""
    counts = nodes.groupBy("fname").agg(F.count(F.lit(1)).alias("n"))
    return files.join(counts, "fname", "left").select(
        "fname", F.lit(None).cast("bigint").alias("mtime"), F.lit(None).cast("string").alias("sha1"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_nodes"),
        F.lit(now_ms).cast("bigint").alias("ingested_at"), F.lit("ok").alias("status"))


def ingest_records(
    records: DataFrame, collection: store.Collection, *, embedder: models.Embedder,
    parser: Parser | None = None, order: list[str] = ORDER, skip_single_line: bool = True,
    max_chars: int | None = filters.MAX_CHARS, upsert: Upsert | None = None,
) -> DataFrame:
    """Ingest the files in ``records`` that the ledger does not list; returns their nodes with vectors.

    Vectors are looked up before they are computed.  A node id is a digest of
    the row, so replacing a row by id and skipping it give the same table, and
    only new rows are appended.  The ledger is written last: a run that breaks
    off leaves files unlisted, and the next run does them again with the same
    result.  ``upsert(collection, nodes)`` takes the place of the insert.

    An embedder with a method ``checked`` (``struct<vec, error>`` of a text) may
    refuse texts for their length: such nodes go to the table ``rejects`` with
    the reason, the others are ingested; any other error fails the run.
    """
    done = collection.read("files", schemas.LEDGER)
    fresh = store.without(records, done, "fname")
    sections = parser(fresh) if parser else markdown_sections(fresh, order, max_chars)
    nodes = cut_lineage(build_nodes(sections, skip_single_line, max_chars))
    unique = store.first_per_key(nodes, ["id"], F.col("fname"))
    cache = collection.read("vectors", schemas.VECTOR)
    if hasattr(embedder, "checked"):
        vectors, refused = _accepted(unique, cache, embedder)
        collection.insert_new("rejects", refused, schemas.REJECT)
        unique = cut_lineage(unique.join(refused.select("id"), "id", "left_anti"))
        nodes = nodes.join(refused.select("id"), "id", "left_anti")
    else:
        vectors = cut_lineage(store.cached_vectors(unique, cache, embedder, embedder.name))
    new_vectors = vectors.where(~F.col("cached")).select(
        "id", F.lit(embedder.name).alias("model"), F.size("embedding").alias("dim"), "embedding")
    collection.append("vectors", new_vectors)
    if upsert:
        upsert(collection, unique)
    else:
        collection.insert_new("nodes", unique, schemas.NODE)
    files = fresh.select("fname").distinct()
    collection.append("files", ledger_rows(files, nodes, int(time.time() * 1000)))
    return unique.join(vectors.select("id", "embedding"), "id")


def _accepted(nodes: DataFrame, cache: DataFrame, embedder: models.Embedder) -> tuple[DataFrame, DataFrame]:
    """``id, embedding, cached`` of the nodes that have or get a vector, and the refused ones with their error."""
    known = cache.where(F.col("model") == embedder.name).select("id", "embedding")
    hits = nodes.select("id").join(known, "id").withColumn("cached", F.lit(True))
    misses = nodes.join(known.select("id"), "id", "left_anti")
    asked = cut_lineage(misses.select("id", "fname", "text", embedder.checked(F.col("text")).alias("result")))
    good, bad = store.vectors_or_rejects(asked)
    vectors = cut_lineage(hits.unionByName(good.select("id", "embedding", F.lit(False).alias("cached"))))
    return vectors, cut_lineage(bad.select("id", "fname", "error", F.length("text").cast("bigint").alias("n_chars")))


def unlisted_files(spark, folder: str, collection: store.Collection, glob: str = day_files.FILE_GLOB) -> list[str]:
    """Paths of the files that the ledger does not list.  Both are compared by name before anything is read."""
    files = spark.createDataFrame(day_files.list_files(spark, folder, glob), "fname string, path string")
    fresh = store.without(files, collection.read("files", schemas.LEDGER), "fname")
    return sorted(r["path"] for r in fresh.select("path").collect())


def ingest_folder(spark, folder: str, collection: store.Collection, glob: str = day_files.FILE_GLOB, **options) -> DataFrame:
    """Ingest the new files of a folder; files the ledger lists are not opened."""
    paths = unlisted_files(spark, folder, collection, glob)
    records = day_files.read_records(spark, paths, glob) if paths else day_files.no_records(spark)
    return ingest_records(records, collection, **options)
