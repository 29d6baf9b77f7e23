"""Queries over labels, keyed tables and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import models
from corpusloom.functions import text as tx
from corpusloom.operators import export, filters, labels, ordered, profile, store
from corpusloom.plans import registry as r
from corpusloom.plans.catalog_text import NODES_SQL, doc_nodes
from corpusloom.plans.registry import query, table


def labelled_vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("cluster"))


def labelled_nodes(spark, d):
    return doc_nodes(spark, d).join(labelled_vectors(spark, d).drop("embedding"), "id")


LABELLED = f"{NODES_SQL}, ln AS (SELECT nodes.*, label cluster FROM nodes JOIN embeddings ON vec_id = id)"


# Cluster aggregates ---------------------------------------------------------

@query("cluster_sizes", "A5", "SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY label")
def _(spark, d):
    return labels.sizes(labelled_vectors(spark, d))


@query("small_clusters", "F11", "SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) < 50")
def _(spark, d):
    return filters.small_clusters(labelled_vectors(spark, d), min_size=50)


@query("cluster_tokens", "A7", f"WITH {LABELLED} SELECT cluster, sum({r.tokens('text')})::BIGINT AS tokens FROM ln GROUP BY cluster")
def _(spark, d):
    return labels.tokens_per_cluster(labelled_nodes(spark, d))


CENTROIDS = """u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) + 1e-9 n FROM (SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings)),
    cell AS (SELECT label, generate_subscripts(e, 1) i, unnest(e) / n x FROM u),
    mean AS (SELECT label, i, avg(x) x FROM cell GROUP BY ALL),
    cn AS (SELECT label, sqrt(sum(x * x)) + 1e-9 n FROM mean GROUP BY label)"""


@query("cluster_centroids", "A6", f"""WITH {CENTROIDS}
    SELECT label AS cluster, (i - 1)::INT AS i, round(x / n, 6) + 0.0 AS x FROM mean JOIN cn USING (label)""")
def _(spark, d):
    c = labels.centroids(labelled_vectors(spark, d))
    return c.select("cluster", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6) + F.lit(0.0))


@query("merged_small_clusters", "C16 J6", f"""WITH {CENTROIDS}, k AS (SELECT label, count(*) n FROM embeddings GROUP BY label),
    s AS (SELECT a.label small, b.label big, round(sum(a.x / ca.n * b.x / cb.n), 6) sim FROM mean a JOIN cn ca ON ca.label = a.label
      JOIN mean b ON a.i = b.i JOIN cn cb ON cb.label = b.label JOIN k ka ON ka.label = a.label JOIN k kb ON kb.label = b.label
      WHERE ka.n < 50 AND kb.n >= 50 GROUP BY ALL),
    t AS (SELECT small, big FROM (SELECT *, row_number() OVER (PARTITION BY small ORDER BY sim DESC, big) rn FROM s) WHERE rn = 1)
    SELECT vec_id AS id, coalesce(big, label) AS cluster FROM embeddings LEFT JOIN t ON small = label""")
def _(spark, d):
    return labels.merge_small(labelled_vectors(spark, d), min_size=50).select("id", "cluster")


@query("cluster_members", "A12 J12 W9", "SELECT label AS cluster, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos, vec_id AS id FROM embeddings")
def _(spark, d):
    return labels.members(labelled_vectors(spark, d))


@query("distinct_labels", "A12 U5", "SELECT DISTINCT label AS cluster FROM embeddings")
def _(spark, d):
    return labelled_vectors(spark, d).select("cluster").distinct()


@query("cluster_texts", "A4 C27", f"""WITH {LABELLED}
    SELECT cluster, string_agg(text, chr(10) || chr(10) ORDER BY id) AS text, count(*) AS n_rows FROM ln GROUP BY cluster""")
def _(spark, d):
    return labels.polish(labelled_nodes(spark, d))


@query("cluster_summaries", "C27 X2")
def _(spark, d):
    return labels.polish(labelled_nodes(spark, d), models.extractive_summary)


@query("cluster_stub_titles", "C26", f"""WITH {LABELLED}
    SELECT cluster, '[Cluster ' || cluster || '] ' || substr(string_agg(text, chr(10) ORDER BY id), 1, 50) || '...' AS title FROM ln GROUP BY cluster""")
def _(spark, d):
    return labels.stub_titles(labelled_nodes(spark, d))


@query("cluster_top_terms", "C26", f"""WITH {LABELLED}, t AS (SELECT cluster, unnest({r.words('lower(text)')}) term FROM ln),
    tf AS (SELECT cluster, term, count(*) tf FROM t GROUP BY ALL), dfs AS (SELECT term, count(*) df FROM tf GROUP BY term),
    s AS (SELECT cluster, term, tf, round(tf * ln((1 + (SELECT count(DISTINCT cluster) FROM ln)) / (1 + df)), 6) + 0.0 score FROM tf JOIN dfs USING (term))
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) rank FROM s) WHERE rank <= 5""")
def _(spark, d):
    return labels.top_terms(labelled_nodes(spark, d))


# Order of labels ------------------------------------------------------------

@query("renumbered_labels", "W7", """WITH f AS (SELECT label, min(vec_id) m FROM embeddings GROUP BY label)
    SELECT vec_id AS id, label AS cluster, k AS new_label FROM embeddings JOIN (SELECT label, row_number() OVER (ORDER BY m) k FROM f) USING (label)""")
def _(spark, d):
    v = labelled_vectors(spark, d).drop("embedding")
    return ordered.renumber_by_first_appearance(v, "cluster", "id").select("id", "cluster", "new_label")


@query("contiguous_groups", "W8", """WITH f AS (SELECT vec_id, label, coalesce((label <> lag(label) OVER (ORDER BY vec_id))::INT, 1) s FROM embeddings)
    SELECT vec_id AS id, label AS cluster, sum(s) OVER (ORDER BY vec_id)::BIGINT AS group_no FROM f""")
def _(spark, d):
    v = labelled_vectors(spark, d).drop("embedding")
    return ordered.contiguous_groups(v, "cluster", "id").select("id", "cluster", "group_no")


@query("first_appearance_order", "W9", """WITH f AS (SELECT label, min(vec_id) m FROM embeddings GROUP BY label)
    SELECT vec_id AS id, label AS cluster, k AS cluster_rank, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos
    FROM embeddings JOIN (SELECT label, row_number() OVER (ORDER BY m) k FROM f) USING (label)""")
def _(spark, d):
    v = labelled_vectors(spark, d).drop("embedding")
    return labels.in_first_appearance_order(v, "cluster", "id").select("id", "cluster", "cluster_rank", "pos")


@query("clusters_by_size", "W11", """SELECT label AS cluster, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS cluster_rank
    FROM embeddings GROUP BY label""")
def _(spark, d):
    return labels.by_size(labelled_vectors(spark, d))


@query("attached_labels", "J9", f"""WITH {NODES_SQL} SELECT id, fname, label AS cluster, row_number() OVER (ORDER BY vec_id) AS pos FROM nodes JOIN embeddings ON vec_id = id""")
def _(spark, d):
    v = labelled_vectors(spark, d).drop("embedding").join(doc_nodes(spark, d).select("id"), "id", "left_semi")
    placed = ordered.number_rows(ordered.arrange(v, "id"), name="pos").select("id", "cluster", "pos")
    return labels.attach(doc_nodes(spark, d).select("id", "fname"), placed, "id")


@query("cluster_titles", "J10", f"""WITH {LABELLED}, t AS (SELECT cluster, 'even ' || cluster AS title FROM ln WHERE cluster % 2 = 0 GROUP BY cluster)
    SELECT DISTINCT ln.cluster, t.title FROM ln LEFT JOIN t ON t.cluster = ln.cluster""")
def _(spark, d):
    c = labelled_nodes(spark, d).select("cluster").distinct()
    titles = c.where("cluster % 2 = 0").select("cluster", F.concat(F.lit("even "), F.col("cluster").cast("string")).alias("title"))
    return c.join(titles, "cluster", "left")


@query("equal_vectors_agree", "J11", """SELECT count(*) AS n_disagreeing FROM (SELECT embedding FROM embeddings GROUP BY embedding HAVING count(DISTINCT label) > 1)""")
def _(spark, d):
    return labels.equal_vectors_agree(labelled_vectors(spark, d), "cluster").agg(F.count(F.lit(1)).alias("n_disagreeing"))


def _clustered_export(heading: str, title: str) -> str:
    return f"""WITH {LABELLED}, k AS (SELECT cluster, count(*) n, row_number() OVER (ORDER BY count(*) DESC, cluster) cluster_rank FROM ln GROUP BY cluster)
    SELECT cluster_rank, 0 AS kind, NULL::BIGINT AS sort_key, NULL::BIGINT AS id, '# Cluster ' || cluster || ' (' || n || '{heading})' || {title} AS block FROM k
    UNION ALL SELECT cluster_rank, 1, ts_ms, id, '### ' || header_path || chr(10) || text FROM ln JOIN k USING (cluster)"""


@query("clustered_export", "K2 W10", _clustered_export("", "CASE WHEN cluster % 2 = 0 THEN ' — even ' || cluster ELSE '' END"))
def _(spark, d):
    n = labelled_nodes(spark, d)
    titles = n.where("cluster % 2 = 0").select("cluster").distinct().withColumn(
        "title", F.concat(F.lit("even "), F.col("cluster").cast("string")))
    return export.cluster_blocks(n, titles=titles, within="ts_ms")


@query("grouped_export", "K3", _clustered_export(" nodes", "''"))
def _(spark, d):
    return export.cluster_blocks_n(labelled_nodes(spark, d), within="ts_ms")


@query("cluster_listing", "W19", f"""WITH {LABELLED}, f AS (SELECT *, coalesce((cluster <> lag(cluster) OVER (ORDER BY id))::INT, 1) s FROM ln),
    g AS (SELECT *, sum(s) OVER (ORDER BY id)::BIGINT group_no FROM f)
    SELECT group_no, 0 AS kind, NULL::BIGINT AS pos, '## Cluster ' || cluster || ' (n=' || count(*) || ')' AS line FROM g GROUP BY group_no, cluster
    UNION ALL SELECT group_no, 1, id, rpad(header_path, greatest(40, length(header_path))::INT, ' ') || ' | ' || {r.shorten('text', 100, ' [...]')} FROM g""")
def _(spark, d):
    return labels.preview_rows(labelled_nodes(spark, d), "cluster", "id")


# Keyed tables ---------------------------------------------------------------

OLD_NEW = f"""{NODES_SQL}, o AS (SELECT * FROM nodes WHERE id % 2 = 0),
    n AS (SELECT id, fname, header_path, 'new' AS title, ts_ms, text FROM nodes WHERE id % 3 = 0)"""


def _old_new(spark, d):
    n = doc_nodes(spark, d)
    return n.where("id % 2 = 0"), n.where("id % 3 = 0").withColumn("title", F.lit("new")).unionByName(
        n.where("id % 3 = 0").withColumn("title", F.lit("new")))


@query("insert_or_ignore", "U1 K5 K7", f"WITH {OLD_NEW} SELECT * FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)")
def _(spark, d):
    old, new = _old_new(spark, d)
    return old.unionByName(store.insert_or_ignore(old, new, "id"))


@query("insert_or_replace", "U2 K7", f"WITH {OLD_NEW} SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)")
def _(spark, d):
    old, new = _old_new(spark, d)
    return store.insert_or_replace(old, new, "id")


@query("last_delivery_wins", "U2", """SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id""")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return store.insert_or_replace(e.limit(0), e, "user_id", F.struct(-F.col("event_id")))


@query("nodes_without_vectors", "U4", "SELECT doc_id AS id FROM documents EXCEPT SELECT vec_id FROM embeddings")
def _(spark, d):
    return store.missing_ids(doc_nodes(spark, d), labelled_vectors(spark, d), "id")


@query("nodes_with_vectors", "J13", "SELECT doc_id AS id, source AS fname FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def _(spark, d):
    return store.having(doc_nodes(spark, d).select("id", "fname"), labelled_vectors(spark, d), "id")


@query("aligned_nodes", "J3 D8", "SELECT doc_id AS id, text, embedding::DOUBLE[] AS embedding, label AS cluster FROM documents JOIN embeddings ON vec_id = doc_id")
def _(spark, d):
    v = labelled_vectors(spark, d).withColumn("embedding", F.col("embedding").cast("array<double>"))
    return store.align(doc_nodes(spark, d).select("id", "text"), v, "id")


@query("unprocessed_files", "J1", """SELECT conv_id AS fname, count(*) AS n FROM conversations
    WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY conv_id""")
def _(spark, d):
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "fname")
    done = c.where("role = 'system'").select("fname").distinct()
    return profile.rows_per(store.without(c, done, "fname"), "fname")


@query("cached_vectors", "J2 K9", f"""WITH {r.hash_vectors('d', 'documents', 'doc_id')}
    SELECT doc_id AS id, vec_id IS NOT NULL AS cached, CASE WHEN vec_id IS NOT NULL THEN round(list_sum(embedding::DOUBLE[]), 6) + 0.0 ELSE round(s, 6) + 0.0 END AS total
    FROM (SELECT doc_id, sum(v) s FROM d_s GROUP BY doc_id) LEFT JOIN embeddings ON vec_id = doc_id""")
def _(spark, d):
    cache = labelled_vectors(spark, d).select("id", "embedding", F.lit("hash-64").alias("model"))
    out = store.cached_vectors(doc_nodes(spark, d), cache, models.HashEmbedder(64), "hash-64")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("id", "cached", (F.round(total, 6) + F.lit(0.0)).alias("total"))


@query("ingest_ledger", "K8 D6", """SELECT conv_id::VARCHAR AS fname, count(*) AS n_nodes, 'ok' AS status FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def _(spark, d):
    from corpusloom.plans.ingest import ledger_rows
    c = table(spark, d, "conversations").where(filters.by_role(F.col("role")))
    rows = c.select(F.col("conv_id").cast("string").alias("fname"))
    return ledger_rows(rows.select("fname").distinct(), rows, 0).select("fname", "n_nodes", "status")


@query("tree_edges_and_depth", "A10 D7 D12", """WITH RECURSIVE e AS (SELECT (doc_id - 1) // 3 AS parent, doc_id AS child FROM documents WHERE doc_id > 0),
    w AS (SELECT DISTINCT parent AS node, 1 AS depth FROM e WHERE parent NOT IN (SELECT child FROM e)
      UNION ALL SELECT e.child, w.depth + 1 FROM w JOIN e ON e.parent = w.node)
    SELECT node, depth FROM w""")
def _(spark, d):
    docs = table(spark, d, "documents").where("doc_id > 0")
    index = docs.groupBy(F.floor((F.col("doc_id") - 1) / 3).alias("id")).agg(F.array_sort(F.collect_list("doc_id")).alias("children"))
    return profile.depths(profile.child_edges(index))


@query("settings_mismatch", "F15 D10", """SELECT DISTINCT 'lang:' || lang AS key, 'chars' AS have, 'words' AS want FROM documents WHERE lang <> 'en'""")
def _(spark, d):
    langs = table(spark, d, "documents").select("lang").distinct()
    key = F.concat(F.lit("lang:"), F.col("lang"))
    have = langs.select(F.create_map(key, F.lit("chars")).alias("properties"))
    want = langs.select(F.create_map(key, F.when(F.col("lang") == "en", F.lit("chars")).otherwise("words")).alias("properties"))
    return store.settings_mismatch(have, want)


@query("provider_rejects", "F13", "SELECT doc_id, 'input cannot exceed 8000 characters' AS error FROM documents WHERE length(text) > 8000")
def _(spark, d):
    docs = table(spark, d, "documents")
    result = F.struct(
        models.HashEmbedder(16)(F.col("text")).alias("vec"),
        F.when(F.length("text") > 8000, F.lit("input cannot exceed 8000 characters")).alias("error"))
    _, bad = store.vectors_or_rejects(docs.withColumn("result", result))
    return bad.select("doc_id", "error")


@query("filtered_nodes", "F4 F5 C5", f"""SELECT doc_id AS id, {r.tokens('text')} AS tokens FROM documents
    WHERE contains({r.strip('text')}, chr(10)) AND length({r.strip('text')}) <= 20000""")
def _(spark, d):
    body = tx.strip(F.col("text"))
    kept = doc_nodes(spark, d).where(filters.multi_line(F.col("text")) & filters.not_too_long(body))
    return kept.select("id", tx.tokens_ceil(F.col("text")).alias("tokens"))
