"""Queries over vectors: distances, top-k, selections, retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import models
from corpusloom.functions import text as tx
from corpusloom.functions import vectors as vx
from corpusloom.operators import bm25, filters, ranking, similarity
from corpusloom.plans import registry as r
from corpusloom.plans import retrieval
from corpusloom.plans.registry import query, table, texts
from corpusloom.sources import tables

VEC = ("vec_id", "embedding")


def vecs(spark, d):
    return table(spark, d, "embeddings")


def centers(spark, d):
    """One vector per label: its member with the smallest id."""
    return vecs(spark, d).groupBy("label").agg(F.min_by("embedding", "vec_id").alias("center"))


CENTERS_SQL = "c AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] center FROM embeddings GROUP BY label)"


@query("vector_distances", "V1", f"""WITH {CENTERS_SQL}, p AS (SELECT vec_id, embedding::DOUBLE[] e, center FROM embeddings JOIN c USING (label)),
    g AS (SELECT vec_id, e, center, list_transform(list_zip(e, center), lambda x: abs(x[1] - x[2])) d FROM p)
    SELECT vec_id, round(1 - list_cosine_similarity(e, center), 6) + 0.0 AS cosine, round(list_sum(d), 6) AS l1,
    round(sqrt(list_sum(list_transform(d, lambda x: x * x))), 6) AS l2, round(list_max(d), 6) AS linf FROM g""")
def _(spark, d):
    pairs = vecs(spark, d).join(centers(spark, d), "label")
    a, b = F.col("embedding"), F.col("center")
    cols = [(F.round(vx.distance(a, b, m), 6) + F.lit(0.0)).alias(m.lower()) for m in vx.METRICS]
    return pairs.select("vec_id", *cols)


@query("inner_products", "V2", f"""WITH {CENTERS_SQL}
    SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], center), 6) + 0.0 AS ip FROM embeddings JOIN c USING (label)""")
def _(spark, d):
    ip = vx.inner_product(F.col("embedding"), F.col("center"))
    return vecs(spark, d).join(centers(spark, d), "label").select("vec_id", (F.round(ip, 6) + F.lit(0.0)).alias("ip"))


@query("unit_vectors", "V3", """WITH n AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings),
    l AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) + 1e-9 n FROM n)
    SELECT vec_id, list_transform(e, lambda x: round(x / n, 6) + 0.0) AS unit FROM l""")
def _(spark, d):
    unit = vx.normalize_l2(F.col("embedding"))
    return vecs(spark, d).select("vec_id", F.transform(unit, lambda x: F.round(x, 6) + F.lit(0.0)).alias("unit"))


@query("vector_scan", "V4 S6", """SELECT vec_id AS id, len(embedding)::INT AS dim, embedding::DOUBLE[] AS embedding FROM embeddings""")
def _(spark, d):
    scan = tables.vector_scan(vecs(spark, d), "vec_id")
    return scan.withColumn("embedding", F.col("embedding").cast("array<double>"))


def hits_sql(k: int = 10) -> str:
    sim = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0"
    return f"""hits AS (SELECT * FROM (SELECT q_id, id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank
      FROM (SELECT a.vec_id q_id, b.vec_id id, {sim} score FROM embeddings a, embeddings b)) WHERE rank <= {k})"""


def hits(spark, d, k: int = 10):
    e = vecs(spark, d)
    return similarity.top_matches(e, e, k, query=VEC, item=VEC)


def token_hits(spark, d, k: int = 10):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return hits(spark, d, k).join(docs.withColumn("tokens", tx.tokens_ceil(F.col("text"))), "id")


TOKEN_HITS = f"""{hits_sql()}, t AS (SELECT hits.*, text, {r.tokens('text')} tokens FROM hits JOIN documents ON doc_id = id)"""


@query("top_k_matches", "J4 W1", f"WITH {hits_sql()} SELECT * FROM hits")
def _(spark, d):
    return hits(spark, d)


@query("top_k_with_cutoff", "F8 C6", f"WITH {hits_sql(8)} SELECT * FROM hits WHERE score >= 0.32")
def _(spark, d):
    e = vecs(spark, d)
    return similarity.top_matches(e, e, 8, query=VEC, item=VEC, cutoff=filters.SIMILARITY_CUTOFF)


@query("nearest_by_metric", "V1 W14 C19", """WITH p AS (SELECT a.vec_id q_id, b.vec_id id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 score
      FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)
    SELECT q_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score, id) rank FROM p) WHERE rank <= 5""")
def _(spark, d):
    e = vecs(spark, d)
    return similarity.top_matches(e, e, 5, query=VEC, item=VEC, metric="L2", exclude_self=True)


@query("distance_order", "W14", f"""WITH {CENTERS_SQL}, p AS (SELECT vec_id, label, round(1 - list_cosine_similarity(embedding::DOUBLE[], center), 6) + 0.0 dist
      FROM embeddings JOIN c USING (label))
    SELECT vec_id, label, dist, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS rank FROM p""")
def _(spark, d):
    from corpusloom.operators.ordered import arrange, number_rows
    dist = F.round(vx.distance(F.col("embedding"), F.col("center")), 6) + F.lit(0.0)
    p = vecs(spark, d).join(centers(spark, d), "label").select("vec_id", "label", dist.alias("dist"))
    return number_rows(arrange(p, "label", "dist", "vec_id"), ["label"], "rank").drop("_row", "_chunk")


@query("threshold_selection", "F9 C19", f"""WITH {CENTERS_SQL}, p AS (SELECT vec_id, label, round(1 - list_cosine_similarity(embedding::DOUBLE[], center), 6) + 0.0 dist
      FROM embeddings JOIN c USING (label))
    SELECT vec_id, label, dist FROM p WHERE dist > 0.5""")
def _(spark, d):
    dist = F.round(vx.distance(F.col("embedding"), F.col("center")), 6) + F.lit(0.0)
    p = vecs(spark, d).join(centers(spark, d), "label").select("vec_id", "label", dist.alias("dist"))
    return p.where(filters.by_distance(F.col("dist"), 0.5))


@query("far_matches", "F9 C19", """SELECT a.vec_id AS q_id, b.vec_id AS id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS distance
    FROM embeddings a, embeddings b WHERE round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) > 1.2""")
def _(spark, d):
    e = vecs(spark, d)
    return similarity.threshold_matches(e, e, 1.2, query=VEC, item=VEC)


@query("pairs_within_distance", "J5", """SELECT a.vec_id AS a, b.vec_id AS b,
      round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS distance
    FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
    WHERE 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 0.7""")
def _(spark, d):
    distinct = similarity.distinct_vectors(vecs(spark, d), "vec_id")
    pairs = similarity.pairs_within(distinct, 0.7)
    return pairs.withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@query("vector_copies", "J11 J5", """SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY embedding) AS rep FROM embeddings""")
def _(spark, d):
    e = vecs(spark, d)
    return similarity.copy_map(e, similarity.distinct_vectors(e, "vec_id"), "vec_id")


@query("budget_prefix", "W2", f"""WITH {TOKEN_HITS}, u AS (SELECT *, sum(tokens) OVER (PARTITION BY q_id ORDER BY rank) s FROM t)
    SELECT q_id, id, rank, tokens, s::BIGINT AS running_tokens FROM u WHERE s <= 3500""")
def _(spark, d):
    out = ranking.budget_prefix(token_hits(spark, d), "tokens", ranking.CONTEXT_TOKENS)
    return out.select("q_id", "id", "rank", "tokens", "running_tokens")


@query("budget_cap", "W3", f"""WITH {TOKEN_HITS}, u AS (SELECT *, sum(tokens) OVER w s, first_value(tokens) OVER w f, min(rank) OVER (PARTITION BY q_id) m,
      row_number() OVER w rn FROM t WINDOW w AS (PARTITION BY q_id ORDER BY rank))
    SELECT q_id, id, rn AS rank, tokens, s::BIGINT AS running_tokens FROM u WHERE rn = 1 OR (f < 2000 AND s <= 2000)""")
def _(spark, d):
    t = token_hits(spark, d)
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("rank")))
    return ranking.budget_cap(t, "tokens").select("q_id", "id", "rank", "tokens", "running_tokens")


@query("budget_inclusive", "W4 C24", f"""WITH {TOKEN_HITS}, u AS (SELECT *, sum(tokens) OVER (PARTITION BY q_id ORDER BY rank) s FROM t)
    SELECT q_id, id, rank, tokens, s::BIGINT AS running_tokens FROM u WHERE rank <= 3500 // 100 AND s - tokens <= 3500""")
def _(spark, d):
    out = ranking.budget_inclusive(token_hits(spark, d), "tokens", 3500, 100)
    return out.select("q_id", "id", "rank", "tokens", "running_tokens")


@query("passage_numbers", "W5", f"WITH {hits_sql(8)} SELECT q_id, rank AS n, id FROM hits WHERE rank <= 5")
def _(spark, d):
    return hits(spark, d, 8).where(F.col("rank") <= min(ranking.PASSAGES_PER_QUESTION, 8)).select(
        "q_id", F.col("rank").alias("n"), "id")


@query("footnotes", "W6", f"""WITH {hits_sql(5)} SELECT rank AS n, 'v-' || arg_min(id, q_id) AS label FROM hits GROUP BY rank""")
def _(spark, d):
    h = hits(spark, d, 5).select("q_id", F.col("rank").alias("n"), F.concat(F.lit("v-"), F.col("id").cast("string")).alias("label"))
    return ranking.footnotes(h)


@query("footnotes_numbered_through", "W6", f"""WITH {hits_sql(5)}
    SELECT row_number() OVER (ORDER BY q_id, rank) AS n, 'v-' || id AS label FROM hits""")
def _(spark, d):
    h = hits(spark, d, 5).select("q_id", F.col("rank").alias("n"), F.concat(F.lit("v-"), F.col("id").cast("string")).alias("label"))
    return ranking.footnotes(h, restart=False)


@query("question_metrics", "A9 K13", f"""WITH {TOKEN_HITS}, u AS (SELECT *, sum(tokens) OVER (PARTITION BY q_id ORDER BY rank) s FROM t WHERE score >= 0.32),
    s AS (SELECT q_id, count(*) n_selected, sum(tokens) selected_token_sum FROM u WHERE s <= 3500 GROUP BY q_id)
    SELECT q_id, count(*) AS n_candidates, count(*) FILTER (WHERE score >= 0.32) AS n_after_cutoff, coalesce(any_value(n_selected), 0) AS n_selected,
    min(score) AS sim_min, max(score) AS sim_max, coalesce(any_value(selected_token_sum), 0)::BIGINT AS selected_token_sum
    FROM t LEFT JOIN s USING (q_id) GROUP BY q_id""")
def _(spark, d):
    t = token_hits(spark, d)
    chosen = ranking.budget_prefix(t.where(F.col("score") >= 0.32), "tokens", ranking.CONTEXT_TOKENS)
    return ranking.question_metrics(t, chosen, filters.SIMILARITY_CUTOFF)


# Text embedded on both sides ------------------------------------------------

@query("hash_embeddings", "X1 C18 K6", f"""WITH {r.hash_vectors('d', 'documents', 'doc_id')}
    SELECT doc_id, b::BIGINT AS bucket, round(v, 6) AS value FROM d_s""")
def _(spark, d):
    v = texts(spark, d).select("doc_id", models.HashEmbedder(64)(F.col("text")).alias("v"))
    cells = v.select("doc_id", F.posexplode("v").alias("bucket", "value")).where("value <> 0")
    return cells.select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.round(F.col("value").cast("double"), 6).alias("value"))


RETRIEVE = f"""{r.hash_vectors('q', 'benchmark', 'item_id')}, {r.hash_vectors('d', 'documents', 'doc_id')},
    dots AS (SELECT item_id, doc_id, sum(q_s.v * d_s.v) s FROM q_s JOIN d_s USING (b) GROUP BY ALL),
    sims AS (SELECT item_id q_id, doc_id id, round(s / (q_n.nn * d_n.nn), 6) + 0.0 score FROM dots JOIN q_n USING (item_id) JOIN d_n USING (doc_id)),
    hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) rank FROM sims) WHERE rank <= 8)"""


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))


def _corpus(spark, d):
    return retrieval.index(texts(spark, d).select(
        F.col("doc_id").alias("id"), "text", F.col("source"), F.lit(None).cast("bigint").alias("ts_ms"),
        F.lit(None).cast("string").alias("exercise_id")), models.HashEmbedder(64))


@query("retrieval", "C6 X5 D9", f"WITH {RETRIEVE} SELECT q_id, id, score, rank FROM hits WHERE score >= 0.32")
def _(spark, d):
    return retrieval.retrieve(_questions(spark, d), _corpus(spark, d), models.HashEmbedder(64)).select("q_id", "id", "score", "rank")


@query("reranked_retrieval", "W16 X7 X9", f"""WITH {RETRIEVE}, w AS (SELECT hits.*, list_distinct({r.words('lower(b.text)')}) qw, list_distinct({r.words('lower(d.text)')}) pw
      FROM hits JOIN benchmark b ON item_id = q_id JOIN documents d ON doc_id = id WHERE score >= 0.32),
    s AS (SELECT q_id, id, score, round(len(list_intersect(qw, pw)) / greatest(len(qw), 1), 6) rerank_score FROM w)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY rerank_score DESC, score DESC, id) rank FROM s) WHERE rank <= 8""")
def _(spark, d):
    out = retrieval.retrieve(_questions(spark, d), _corpus(spark, d), models.HashEmbedder(64), reranker=models.overlap_reranker)
    return out.select("q_id", "id", "score", "rerank_score", "rank")


@query("bm25_reranked", "X7 X9 W16", f"""WITH {RETRIEVE}, dw AS (SELECT doc_id, {r.words("lower(coalesce(text, ''))")} w FROM documents),
    st AS (SELECT count(*) n_docs, avg(len(w)) mean FROM dw), df AS (SELECT t, count(*) df FROM (SELECT doc_id, unnest(list_distinct(w)) t FROM dw) GROUP BY t),
    qt AS (SELECT item_id q_id, unnest(list_distinct({r.words('lower(text)')})) t FROM benchmark),
    s AS (SELECT hits.q_id, hits.id, any_value(score) score, round(sum(ln(1 + (n_docs - df.df + 0.5) / (df.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))), 6) + 0.0 rerank_score
      FROM (SELECT hits.*, w, qt.t, len(list_filter(w, lambda x: x = qt.t)) tf FROM hits JOIN dw ON doc_id = id JOIN qt USING (q_id) WHERE score >= 0.32) hits
      LEFT JOIN df USING (t), st GROUP BY hits.q_id, hits.id)
    SELECT * FROM (SELECT q_id, id, score, coalesce(rerank_score, 0) AS rerank_score, row_number() OVER (PARTITION BY q_id ORDER BY coalesce(rerank_score, 0) DESC, score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def _(spark, d):
    q, corpus = _questions(spark, d), _corpus(spark, d)
    found = retrieval.retrieve(q, corpus, models.HashEmbedder(64))
    out = bm25.rerank(found, q, table(spark, d, "documents"), 5)
    return out.select("q_id", "id", "score", "rerank_score", "rank")


@query("context_only_answers", "C7 W5 P12 P14 D15", f"""WITH {RETRIEVE}, p AS (SELECT q_id, rank,
      '**Passage ' || rank || '** — ' || source || chr(10) || chr(10) || text || chr(10) t FROM hits JOIN documents ON doc_id = id WHERE rank <= 5 AND score >= 0.32)
    SELECT item_id AS q_id, any_value(text) AS question, CASE WHEN count(t) = 0 THEN '_No passages found._'
      ELSE '_LLM disabled: showing top passages._' || chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY rank) END AS answer,
      count(t) AS n_citations FROM benchmark LEFT JOIN p ON q_id = item_id GROUP BY item_id""")
def _(spark, d):
    q = _questions(spark, d)
    h = retrieval.retrieve(q, _corpus(spark, d), models.HashEmbedder(64))
    out = retrieval.answer_context_only(q, h)
    return out.select("q_id", "question", "answer", F.size("citations").cast("bigint").alias("n_citations"))


@query("model_answers", "C8 P20 X3")
def _(spark, d):
    q = _questions(spark, d)
    h = retrieval.retrieve(q, _corpus(spark, d), models.HashEmbedder(64))
    return retrieval.answer_with_model(q, h, models.extractive_answer).drop("citations")


@query("report_blocks", "K11 W6", f"""WITH {RETRIEVE}, p AS (SELECT q_id, rank, source,
      '**Passage ' || rank || '** — ' || source || chr(10) || chr(10) || text || chr(10) t FROM hits JOIN documents ON doc_id = id WHERE rank <= 5 AND score >= 0.32),
    a AS (SELECT item_id, row_number() OVER (ORDER BY item_id) idx, any_value(text) q, CASE WHEN count(t) = 0 THEN '_No passages found._'
      ELSE '_LLM disabled: showing top passages._' || chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY rank) END ans FROM benchmark LEFT JOIN p ON q_id = item_id GROUP BY item_id)
    SELECT 1 AS part, idx AS pos, '## Q' || idx || '. ' || q || chr(10) || chr(10) || ans || chr(10) AS block FROM a
    UNION ALL SELECT 0, 0, '---' || chr(10) || 'config:' || chr(10) || '  theme: redux' || chr(10) || '  layout: fixed' || chr(10) || '---' || chr(10) || '# Daily FAQ — all' || chr(10) || chr(10)
    UNION ALL SELECT 2, 0, chr(10) || '---' || chr(10) || '## Sources' || chr(10)
    UNION ALL SELECT 3, rank, '[^' || rank || ']: ' || arg_min(source, q_id) || chr(10) FROM p GROUP BY rank""")
def _(spark, d):
    q = _questions(spark, d)
    h = retrieval.retrieve(q, _corpus(spark, d), models.HashEmbedder(64))
    return retrieval.report_blocks("all", retrieval.answer_context_only(q, h))


@query("flat_index_search", "C24 C3 V2", None)
def _(spark, d):
    docs = texts(spark, d).select("doc_id", "text")
    flat = retrieval.flat_index(docs, "doc_id", models.HashEmbedder(64))
    return retrieval.flat_search(_questions(spark, d), flat, models.HashEmbedder(64), top_k=5)
