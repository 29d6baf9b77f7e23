"""Queries that iterate: hierarchical and mixture clustering, trees, ingest chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import models
from corpusloom.functions import text as tx
from corpusloom.operators import agglomerate, long_texts, mixture, ordered, tree
from corpusloom.plans import corpus, ingest, retrieval
from corpusloom.plans.catalog_tables import labelled_vectors
from corpusloom.plans.catalog_text import CHUNKS_SQL, _conversation_records, doc_nodes
from corpusloom.plans.registry import query, table, texts
from corpusloom.session import cut_lineage

CUT = 0.7
EMBEDDER = models.HashEmbedder(64)


@query("single_linkage_clusters", "C13", """WITH RECURSIVE e AS (SELECT a.vec_id x, b.vec_id y FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
      WHERE 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 0.65),
    r AS (SELECT vec_id x, vec_id root FROM embeddings UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x)
    SELECT x AS id, min(root) AS cluster FROM r GROUP BY x""")
def _(spark, d):
    return agglomerate.cluster(labelled_vectors(spark, d), 0.65, linkage="single").labels


@query("complete_linkage_clusters", "C13")
def _(spark, d):
    return agglomerate.cluster(labelled_vectors(spark, d), CUT).labels


@query("average_linkage_clusters", "C13")
def _(spark, d):
    return agglomerate.cluster(labelled_vectors(spark, d), CUT, linkage="average").labels


@query("leaf_order", "C15 W7")
def _(spark, d):
    v = labelled_vectors(spark, d)
    return agglomerate.leaf_order(agglomerate.cluster(v, CUT), v)


@query("clusters_by_count", "C14")
def _(spark, d):
    v = labelled_vectors(spark, d)
    found = agglomerate.cluster(v, CUT)
    most = found.members.select("rep").distinct().count()
    return agglomerate.cut_to_count(found, int(most * 0.9))


@query("cluster_counts", "C14", "SELECT k, k AS n_clusters, (SELECT count(DISTINCT vec_id) FROM embeddings) AS n_members FROM (VALUES (10::BIGINT), (50)) t(k)")
def _(spark, d):
    """Fewer clusters than the distance cut leaves: the cut is widened, once, from the clusters that are left."""
    found = agglomerate.grown_to(agglomerate.cluster(labelled_vectors(spark, d), CUT, linkage="single"), 10)
    out = None
    for k in (10, 50):
        row = agglomerate.cut_to_count(found, k).agg(F.lit(k).cast("bigint").alias("k"), F.count_distinct("cluster").alias("n_clusters"),
                                                     F.count_distinct("id").alias("n_members"))
        out = row if out is None else out.unionByName(row)
    return out


@query("leaf_order_holds", "C15", """SELECT count(DISTINCT vec_id) AS n_members, true AS positions_are_a_permutation, true AS clusters_stand_together
    FROM embeddings""")
def _(spark, d):
    """What every leaf order must keep."""
    v = labelled_vectors(spark, d)
    order = cut_lineage(agglomerate.leaf_order(agglomerate.cluster(v, CUT), v))
    spans = order.groupBy("cluster").agg((F.max("leaf_pos") - F.min("leaf_pos") + 1 == F.count(F.lit(1))).alias("together"))
    whole = (F.min("leaf_pos") == 1) & (F.max("leaf_pos") == F.count(F.lit(1))) & (F.count_distinct("leaf_pos") == F.count(F.lit(1)))
    return order.agg(F.count_distinct("id").alias("n_members"), whole.alias("positions_are_a_permutation")).crossJoin(
        spans.agg(F.every("together").alias("clusters_stand_together")))  # single rows


@query("bisecting_clusters", "C14")
def _(spark, d):
    return agglomerate.bisecting(labelled_vectors(spark, d), 10)


def _points(spark, d):
    return labelled_vectors(spark, d).select(F.col("id").alias("node_id"), "embedding")


def _doc_points(spark, d):
    """Hash embeddings of all documents: vectors with structure (languages, copies, templates)."""
    docs = texts(spark, d).select(F.col("doc_id").alias("node_id"), "text")
    return cut_lineage(docs.select("node_id", tx.tokens_ceil(F.col("text")).alias("tokens"), EMBEDDER(F.col("text")).alias("embedding")))


@query("reduced_vectors", "C9")
def _(spark, d):
    return mixture.reduce_dimensions(_points(spark, d)).select("node_id", F.posexplode("x").alias("axis", "value"))


@query("mixture_labels", "C10 F10 A11")
def _(spark, d):
    x = cut_lineage(mixture.reduce_dimensions(_doc_points(spark, d)))
    return mixture.soft_labels(x.withColumn("problem", F.lit(0).cast("bigint"))).select("node_id", "label")


@query("two_level_clusters", "C11 U5")
def _(spark, d):
    v = _doc_points(spark, d).withColumn("problem", F.lit(0).cast("bigint"))
    return mixture.two_level(v).select("node_id", "cluster")


@query("token_bounded_clusters", "C12 X4")
def _(spark, d):
    return mixture.bounded_clusters(_doc_points(spark, d))


@query("token_bound_holds", "C12", """SELECT count(*) AS n_documents, 0::BIGINT AS n_lost, 0::BIGINT AS n_over_the_bound, true AS several_clusters
    FROM documents WHERE text IS NOT NULL""")
def _(spark, d):
    """What every bounded clustering must keep: all documents, and no cluster of several over the bound."""
    points = _doc_points(spark, d)
    found = mixture.bounded_clusters(points)
    cells = found.join(points.select("node_id", "tokens"), "node_id").groupBy("cluster").agg(
        F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("n"))
    over = (F.col("total") > mixture.MAX_CLUSTER_TOKENS) & (F.col("n") > 1)
    kept = found.agg(F.count_distinct("node_id").alias("kept"))
    return points.agg(F.count(F.lit(1)).alias("n_documents")).crossJoin(kept).crossJoin(cells.agg(  # single rows
        F.count(F.when(over, 1)).alias("n_over_the_bound"), (F.count(F.lit(1)) > 1).alias("several_clusters"))).select(
        "n_documents", (F.col("n_documents") - F.col("kept")).alias("n_lost"), "n_over_the_bound", "several_clusters")


def _chunk_points(spark, d):
    """The chunks of every document as a problem of its own: as many problems as documents, each bounded by its text."""
    chunks = long_texts.split_texts(texts(spark, d), "doc_id")
    numbered = ordered.number_rows(ordered.arrange(chunks, "doc_id", "chunk_no"), name="node_id")
    return cut_lineage(numbered.select(F.col("doc_id").alias("problem"), "node_id", EMBEDDER(F.col("text")).alias("embedding")))


@query("chunk_clusters", "C11 C10", f"SELECT doc_id, count(*) AS n_chunks FROM ({CHUNKS_SQL}) GROUP BY doc_id")
def _(spark, d):
    """Two levels of soft clusters inside every document; each chunk is in a cluster of its own document."""
    found = mixture.two_level(_chunk_points(spark, d))
    return found.groupBy(F.col("problem").alias("doc_id")).agg(F.count_distinct("node_id").alias("n_chunks"))


@query("chunk_mixtures", "C10 A11 F10 C9", f"SELECT count(*) AS n_chunks, 0::BIGINT AS n_foreign_labels FROM ({CHUNKS_SQL})")
def _(spark, d):
    """Soft labels inside every document: labels count from 0 and stay below the number of its chunks."""
    points = _chunk_points(spark, d)
    x = cut_lineage(mixture.reduce_per_problem(points, mixture.DIMENSIONS, mixture.LOCAL_ROWS))
    labels = mixture.soft_labels(x).groupBy("problem").agg(F.max("label").alias("last"), F.min("label").alias("first"))
    sizes = points.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
    foreign = (F.col("last") >= F.col("n")) | (F.col("first") < 0)
    return sizes.join(labels, "problem", "left").agg(F.sum("n").alias("n_chunks"), F.count_if(foreign).alias("n_foreign_labels"))


_TREES: dict[tuple[str, str], tree.Tree] = {}


def _tree(spark, d):
    """The corpus tree; its tables are written once per application and read by every search.

    Numbers depend on members alone, so it is the same tree whichever query builds it.
    """
    key = (spark.sparkContext.applicationId, d)
    if key not in _TREES:
        docs = texts(spark, d).select("doc_id", "text")
        _TREES[key] = tree.build(tree.leaves(docs, EMBEDDER), EMBEDDER)
    return _TREES[key]


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))


@query("tree_leaves", "C18 W17 S12", f"""SELECT row_number() OVER (ORDER BY doc_id, chunk_no) - 1 AS node_id, 0 AS layer, text
    FROM ({CHUNKS_SQL})""")
def _(spark, d):
    docs = texts(spark, d).select("doc_id", "text")
    return tree.leaves(docs, EMBEDDER).select("node_id", "layer", "text")


@query("summary_tree", "C17 A13 A14 X2 U3 W18 D12 D13")
def _(spark, d):
    built = _tree(spark, d)
    kids = tree.children_of(built.edges).select(F.col("parent").alias("node_id"), F.size("children").alias("n_children"))
    return built.nodes.join(kids, "node_id", "left").select(
        "node_id", "layer", F.length("text").alias("n_chars"), F.coalesce("n_children", F.lit(0)).alias("n_children"))


@query("tree_answers", "C20 C22 C23 J8 P21")
def _(spark, d):
    return tree.answer(_tree(spark, d), _questions(spark, d), EMBEDDER)


@query("tree_layer_search", "C21 J7 W15")
def _(spark, d):
    built = _tree(spark, d)
    found = tree.search_layers(built, _questions(spark, d), EMBEDDER, built.num_layers, built.num_layers + 1, top_k=5)
    return found.select("q_id", "step", "step_rank", "node_id", "layer", "dist")


@query("day_sections", "C1 C5", r"""WITH h AS (SELECT DISTINCT conv_id FROM conversations),
    a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) rn, text FROM conversations WHERE role = 'assistant'),
    s AS (SELECT conv_id, 1 section_no, '# ' || conv_id AS text, '/' AS header_path FROM h
      UNION ALL SELECT conv_id, CASE WHEN turn = 0 THEN 2 ELSE 2 * rn END - CASE WHEN turn <> 0 AND EXISTS (SELECT 1 FROM a z WHERE z.conv_id = a.conv_id AND z.turn = 0) THEN 1 ELSE 0 END,
        '## untitled' || CASE WHEN turn = 0 THEN chr(10) || text ELSE '' END, '/' || conv_id || '/' FROM a
      UNION ALL SELECT conv_id, 2 * rn + 1 - CASE WHEN EXISTS (SELECT 1 FROM a z WHERE z.conv_id = a.conv_id AND z.turn = 0) THEN 1 ELSE 0 END,
        '### ' || strftime(make_timestamp(turn * 1000000), '%Y-%m-%dT%H:%M:%S') || chr(10) || text, '/' || conv_id || '/untitled/' FROM a WHERE turn <> 0)
    SELECT conv_id AS fname, section_no::BIGINT AS section_no, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, header_path FROM s""")
def _(spark, d):
    found = ingest.markdown_sections(_conversation_records(spark, d))
    return found.select("fname", "section_no", "text", "header_path")


@query("ingested_nodes", "C5 F4 F5 P3 X6")
def _(spark, d):
    return ingest.build_nodes(ingest.markdown_sections(_conversation_records(spark, d)))


@query("analysed_corpus", "C29 K14 W11")
def _(spark, d):
    vectors = labelled_vectors(spark, d).select("id", "embedding")
    return corpus.analyse_corpus(doc_nodes(spark, d), vectors, cut=CUT).select("id", "cluster", "leaf_pos")


@query("run_report", "A8 K12 D16")
def _(spark, d):
    docs = table(spark, d, "documents")
    nodes = retrieval.index(texts(spark, d), EMBEDDER)
    row = corpus.RunReport("all", d, "report", warnings=["sample"]).row(docs, nodes, finished_at=0.0)
    return row.select("date", "docs_loaded", "nodes_embedded", "top_k", "similarity_cutoff", "token_cap", "llm", "embed_model", "reranker", "warnings")
