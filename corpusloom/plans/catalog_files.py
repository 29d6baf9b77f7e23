"""Queries over files that Spark writes from the tables: day files, collections, streams, saved trees."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import schemas
from corpusloom.functions import models
from corpusloom.functions import text as tx
from corpusloom.operators import export, polish, store
from corpusloom.plans import catalog_tables, catalog_vectors, corpus, ingest, retrieval  # noqa: F401 - their queries are written here
from corpusloom.plans import registry as r
from corpusloom.plans.catalog_iterative import EMBEDDER, _tree
from corpusloom.plans.catalog_text import _conversation_records
from corpusloom.plans.registry import QUERIES, query, table
from corpusloom.session import ensure_checkpoint_dir
from corpusloom.sources import concatenated, day_files, tables
from corpusloom.streaming import ingest as stream

GLOB = "*.json"


def _scratch(spark, what: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _records(spark, d):
    return table(spark, d, "conversations").select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.col("conv_id").cast("string").alias("conversation_id"), (F.col("turn") * 1000).alias("timestamp"),
        "role", F.col("text").alias("content"))


def _day_folder(spark, d) -> str:
    """All conversations as JSON Lines files."""
    folder = _scratch(spark, "days")
    _records(spark, d).repartition("conversation_id").write.json(folder)
    return folder


@query("day_file_documents", "S1 F2 K4", f"SELECT {r.strip('text')} AS text, turn * 1000 AS ts_ms FROM conversations WHERE {r.strip('text')} <> ''")
def _(spark, d):
    return day_files.documents(day_files.read_records(spark, _day_folder(spark, d), GLOB)).select("text", "ts_ms")


@query("assistant_documents", "S2 U6", """SELECT conv_id::VARCHAR AS conversation_id, conv_id || '-' || turn AS id, text, turn * 1000 AS ts_ms
    FROM conversations WHERE role = 'assistant'""")
def _(spark, d):
    docs = day_files.assistant_documents(day_files.read_records(spark, _day_folder(spark, d), GLOB))
    return docs.select("conversation_id", "id", "text", "ts_ms")


@query("malformed_lines", "F3", "SELECT '{' || replace(text, chr(10), ' ') AS line FROM benchmark")
def _(spark, d):
    folder = _scratch(spark, "dirty")
    good = _records(spark, d).select(F.to_json(F.struct("*")).alias("value"))
    bad = table(spark, d, "benchmark").select(F.concat(F.lit("{"), tx.newlines_to_spaces(F.col("text"))).alias("value"))
    good.unionByName(bad).write.text(folder)
    return day_files.malformed_lines(spark, folder, "*.txt").select("line")


@query("concatenated_objects", "S3", """SELECT conv_id::VARCHAR AS conversation_id, conv_id || '-' || turn AS id, role, text AS content FROM conversations""")
def _(spark, d):
    folder = _scratch(spark, "joined")
    rows = _records(spark, d).repartition("conversation_id").select(F.to_json(F.struct("*")).alias("value"))
    rows.write.option("lineSep", " ").text(folder)
    return concatenated.read_records(spark, folder).select("conversation_id", "id", "role", "content")


@query("streamed_objects", "T3 S3", """SELECT conv_id::VARCHAR AS conversation_id, conv_id || '-' || turn AS id, role, text AS content FROM conversations""")
def _(spark, d):
    """Concatenated JSON as a stream: every file once, each cut into byte ranges; the second run finds nothing new."""
    folder, coll, checkpoint = _scratch(spark, "joined"), store.Collection(spark, _scratch(spark, "collection")), _scratch(spark, "stream")
    rows = _records(spark, d).repartition("conversation_id").select(F.to_json(F.struct("*")).alias("value"))
    rows.write.option("lineSep", " ").text(folder)
    kept = T.StructType([T.StructField(c, T.StringType()) for c in ("conversation_id", "id", "role", "content")])
    for _ in range(2):
        stream.start_concatenated(spark, folder, checkpoint, lambda found, _: coll.insert_new("records", found.select(*kept.names), kept)).awaitTermination()
    return coll.read("records", kept)


@query("whole_text_files", "S10 S12", f"SELECT unnest(string_split({r.clean('text')}, chr(10))) AS lines FROM benchmark")
def _(spark, d):
    folder = _scratch(spark, "texts")
    n = table(spark, d, "benchmark").count()
    table(spark, d, "benchmark").repartitionByRange(n, "item_id").select("text").write.text(folder)
    texts = day_files.read_texts(spark, f"{folder}/*.txt").where(F.length("text") > 0)
    return polish.polish_files(texts).select(F.explode(F.split("text", "\n")).alias("lines"))


@query("stored_collection", "K5 K6 K7 K15 F14", """SELECT doc_id::VARCHAR AS id, source AS fname, text FROM documents""")
def _(spark, d):
    coll = store.Collection(spark, _scratch(spark, "collection"))
    nodes = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("fname"), F.lit("/").alias("header_path"),
        F.lit("").alias("title"), F.lit(None).cast("bigint").alias("ts_ms"), "text")
    coll.insert_new("nodes", nodes, schemas.NODE)
    coll.insert_new("nodes", nodes, schemas.NODE)
    return coll.require_rows("nodes", schemas.NODE).select("id", "fname", "text")


@query("upserted_collection", "K7 U2", """SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'checked: ' || text ELSE text END AS text FROM documents""")
def _(spark, d):
    """All documents stored, the labelled ones delivered again: an upsert into a table that already has rows."""
    coll = store.Collection(spark, _scratch(spark, "collection"))
    kept = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    coll.upsert("nodes", docs, kept)
    again = docs.join(table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id")), "id", "left_semi")
    coll.upsert("nodes", again.withColumn("text", F.concat(F.lit("checked: "), F.col("text"))), kept)
    return coll.require_rows("nodes", kept)


_SECTION = r"""SELECT DISTINCT regexp_replace(CASE WHEN turn = 0 THEN '## untitled' ELSE '### ' || strftime(make_timestamp(turn * 1000000), '%Y-%m-%dT%H:%M:%S') END
    || chr(10) || text, '^\s+|\s+$', '', 'g') AS text FROM conversations WHERE role = 'assistant'"""


@query("streamed_nodes", "T1 T2 T4 C5 K8", _SECTION)
def _(spark, d):
    folder, coll = _day_folder(spark, d), store.Collection(spark, _scratch(spark, "collection"))
    checkpoint = _scratch(spark, "stream")
    for _ in range(2):
        records = stream.record_stream(spark, folder, max_files=2, glob=GLOB)
        stream.start_ingest(records, coll, checkpoint, EMBEDDER).awaitTermination()
    return coll.read("nodes", schemas.NODE).select("text").distinct()


# Sinks, written and read back -------------------------------------------------

def _lines(blocks: str, separator: bool = True) -> str:
    """The lines of a report file: every block, then an empty line where blocks are separated by one."""
    if separator:
        return f"SELECT unnest(list_append(string_split(block, chr(10)), '')) AS line FROM ({blocks})"
    return f"SELECT unnest(string_split(regexp_replace(block, '\\n\\z', ''), chr(10))) AS line FROM ({blocks})"


def _read_lines(spark, folder):
    return spark.read.option("lineSep", "\n").text(folder).select(F.col("value").alias("line"))


def _written_report(name: str, covers: str, of: str):
    @query(name, covers, _lines(QUERIES[of].sql))
    def _(spark, d):
        folder = _scratch(spark, "report")
        export.write_blocks(QUERIES[of].run(spark, d), folder)
        return _read_lines(spark, folder)


_written_report("written_flat_export", "K1", "flat_export")
_written_report("written_clustered_export", "K2", "clustered_export")
_written_report("written_grouped_export", "K3", "grouped_export")


@query("written_documents", "K4", QUERIES["document_dump"].sql)
def _(spark, d):
    folder = _scratch(spark, "dump")
    docs = QUERIES["document_dump"].run(spark, d)
    export.write_documents_json(docs, folder)
    return spark.read.schema(docs.schema).json(folder)


@query("written_report", "K11", _lines(QUERIES["report_blocks"].sql, separator=False))
def _(spark, d):
    folder = _scratch(spark, "report")
    export.write_blocks(QUERIES["report_blocks"].run(spark, d), folder, [F.col("part"), F.col("pos")], separator="")
    return _read_lines(spark, folder)


@query("written_run_report", "K12 A8 D16", """SELECT 'all' AS date, 'in' AS input_file, 'out' AS output_file, count(*) AS docs_loaded, count(*) AS nodes_embedded,
    8::BIGINT AS top_k, 0.32::DOUBLE AS similarity_cutoff, ['one', 'two'] AS warnings FROM documents""")
def _(spark, d):
    """The run report as JSON, read back; its Markdown names the same counts."""
    folder, docs = _scratch(spark, "run"), table(spark, d, "documents")
    row = corpus.RunReport("all", "in", "out", warnings=["one", "two"]).row(docs, retrieval.index(docs, EMBEDDER), finished_at=0.0)
    row.write.json(folder)
    return spark.read.json(folder).select("date", "input_file", "output_file", "docs_loaded", "nodes_embedded", "top_k", "similarity_cutoff", "warnings")


@query("run_report_page", "K12", f"""WITH n AS (SELECT count(*) c FROM documents)
    SELECT '**Warnings**' AS line, 1::BIGINT AS n UNION ALL SELECT '- Docs loaded: **' || c || '**', 1 FROM n UNION ALL SELECT '- Nodes embedded: **' || c || '**', 1 FROM n
    UNION ALL SELECT '- one', 1 UNION ALL SELECT '- two', 1 UNION ALL SELECT '- Output: `out`', 1""")
def _(spark, d):
    folder, docs = _scratch(spark, "run"), table(spark, d, "documents")
    row = corpus.RunReport("all", "in", "out", warnings=["one", "two"]).row(docs, docs, finished_at=0.0)
    corpus.report_markdown(row).write.text(folder)
    said = F.col("line").rlike("^(- (Docs|Nodes|one|two|Output)|[*]{2}Warnings)")
    return _read_lines(spark, folder).where(said).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("written_question_metrics", "K13", QUERIES["question_metrics"].sql)
def _(spark, d):
    folder = _scratch(spark, "metrics")
    metrics = QUERIES["question_metrics"].run(spark, d)
    corpus.write_question_metrics(metrics, folder)
    return spark.read.schema(metrics.schema).option("header", True).csv(folder)


@query("written_concat", "K14", _lines("SELECT text AS block FROM documents WHERE text IS NOT NULL"))
def _(spark, d):
    folder = _scratch(spark, "concat")
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text", F.col("n_chars").alias("leaf_pos"))
    export.write_blocks(export.concat_blocks(docs, "leaf_pos"), folder)
    return _read_lines(spark, folder)


@query("ingest_rejects", "C5 F13", f"""WITH s AS ({QUERIES["day_sections"].sql})
    SELECT DISTINCT fname::VARCHAR AS fname, length(text) AS n_chars FROM s WHERE contains(text, chr(10)) AND length(text) <= 20000 AND (length(text) + 3) // 4 > 40""")
def _(spark, d):
    """Sections that the embedder refuses are set aside inside the ingest; the others are stored."""
    coll = store.Collection(spark, _scratch(spark, "collection"))
    records = _conversation_records(spark, d).withColumn("fname", F.col("fname").cast("string")).withColumn("day", F.col("day").cast("string"))
    ingest.ingest_records(records, coll, embedder=models.LimitedEmbedder(EMBEDDER, 40))
    return coll.read("rejects", schemas.REJECT).select("fname", "n_chars").distinct()


@query("stored_vector_audit", "C25", """SELECT count(*) AS n_sampled, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS n_different
    FROM documents WHERE text IS NOT NULL""")
def _(spark, d):
    """Vectors are stored, then the labelled documents change: embedding them again tells which stored vectors are stale."""
    coll = store.Collection(spark, _scratch(spark, "collection"))
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), "text")
    vectors = retrieval.index(docs, EMBEDDER).select("id", "model", F.size("embedding").alias("dim"), "embedding")
    coll.insert_new("vectors", vectors, schemas.VECTOR)
    changed = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id")).distinct().withColumn("_changed", F.lit("checked: "))
    now = docs.join(changed, "id", "left").select("id", F.concat(F.coalesce("_changed", F.lit("")), F.col("text")).alias("text"))
    return retrieval.audit(now.join(coll.read("vectors", schemas.VECTOR).select("id", "embedding"), "id"), EMBEDDER)


@query("saved_tree", "K10 S11")
def _(spark, d):
    built, path = _tree(spark, d), _scratch(spark, "tree")
    tables.write_tree(built.nodes, built.edges, path)
    nodes, edges = tables.read_tree(spark, path)
    return nodes.groupBy("layer").agg(F.count(F.lit(1)).alias("n_nodes"))


@query("built_corpus", "C28")
def _(spark, d):
    built = corpus.build_corpus(spark, _day_folder(spark, d), _scratch(spark, "corpus"), EMBEDDER, glob=GLOB)
    return built.nodes.groupBy("layer").agg(F.count(F.lit(1)).alias("n_nodes"))
