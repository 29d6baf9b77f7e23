"""Retrieval and answering for many questions in one job."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import models
from corpusloom.functions import text as tx
from corpusloom.operators import filters, long_texts, ordered, ranking, similarity
from corpusloom.session import cut_lineage

# Texts of the daily report.
GUARD = ("Answer tersely; bullets where natural. Cite sources inline as [^1],[^2] "
         "and include a Sources section mapping footnotes to titles/ids.")
PASSAGES_INTRO = "_LLM disabled: showing top passages._\n\n"
NO_PASSAGES = "_No passages found._"
FRONT_MATTER = "---\nconfig:\n  theme: %s\n  layout: %s\n---\n# Daily FAQ — %s\n\n"
NO_NOTES = "_No notes found._\n"
SOURCES_HEAD = "\n---\n## Sources\n"


def index(docs: DataFrame, embedder: models.Embedder, text: str = "text") -> DataFrame:
    """Documents with ``embedding`` and the ``model`` that made it."""
    return docs.withColumn("embedding", embedder(F.col(text))).withColumn("model", F.lit(embedder.name))


def flat_index(docs: DataFrame, key: str, embedder: models.Embedder, max_tokens: int = 100) -> DataFrame:
    """Token-bounded chunks of each document with their vectors."""
    rows = long_texts.split_texts(docs, key, max_tokens=max_tokens)
    named = rows.select(F.concat_ws("-", F.col(key).cast("string"), F.lpad(F.col("chunk_no").cast("string"), 8, "0")).alias("id"),
                        key, "chunk_no", "text")
    return index(named, embedder)


def flat_search(questions: DataFrame, flat: DataFrame, embedder: models.Embedder, top_k: int | None = 5,
                max_context: int = 3500, max_tokens: int = 100) -> DataFrame:
    """Inner-product search; by ``top_k``, or by context budget when it is None."""
    k = top_k or max_context // max_tokens
    q = questions.withColumn("q_vec", embedder(F.col("question")))
    hits = similarity.top_matches(q, flat, k, metric="inner_product")
    # The hits are at most k per question; their texts come by a join on id.
    found = with_payload(hits, flat.select("id", "text", tx.tokens_ceil(F.col("text")).alias("tokens")))
    if top_k is None:
        found = ranking.budget_inclusive(found, "tokens", max_context, max_tokens)
    return found.select("q_id", "id", "score", "rank", "text")


def with_payload(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Attach corpus columns to hits.

    Hits are at most k per question.  They are written first, so the corpus is
    scored once and the planner knows from the file size whether to broadcast
    them or to shuffle both sides.
    """
    return corpus.join(cut_lineage(hits), "id")


def retrieve(
    questions: DataFrame, corpus: DataFrame, embedder: models.Embedder, *,
    top_k: int = ranking.TOP_K, cutoff: float | None = filters.SIMILARITY_CUTOFF,
    reranker: models.Reranker | None = None, token_cap: int | None = None,
    post: Iterable[Callable[[DataFrame], DataFrame]] = (),
) -> DataFrame:
    """Hits of ``questions(q_id, question)`` in ``corpus(id, text, embedding, model, ...)``.

    Chain: top k, similarity cutoff, reranker, token cap, then ``post``.
    Set an option to None to switch its step off.
    """
    q = questions.withColumn("q_vec", embedder(F.col("question")))
    hits = similarity.top_matches(q, corpus.where(F.col("model") == embedder.name), top_k, cutoff=cutoff)
    found = with_payload(hits, corpus.drop("embedding", "model"))
    if reranker is not None:
        asked = found.join(questions, "q_id")
        found = ranking.rerank(asked, reranker(F.col("question"), F.col("text")), top_k).drop("question")
    if token_cap is not None:
        found = ranking.budget_cap(found.withColumn("tokens", tx.tokens_ceil(F.col("text"))), "tokens", token_cap)
    return ranking.postprocess(found, post)


def _cited(hits: DataFrame, per_q: int) -> DataFrame:
    label = tx.citation_label(F.col("rank"), F.col("exercise_id"), F.col("ts_ms"), F.col("source"))
    return hits.where(F.col("rank") <= per_q).withColumn("label", label)


def answer_context_only(questions: DataFrame, hits: DataFrame, per_q: int = ranking.PASSAGES_PER_QUESTION) -> DataFrame:
    """``q_id, question, answer, citations`` stitched from at most ``per_q`` passages."""
    passage = tx.passage_block(F.col("rank"), F.col("label"), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("n"), "label", passage.alias("t"))))
    found = _cited(hits, per_q).groupBy("q_id").agg(rows.alias("p"))
    joined = questions.join(found, "q_id", "left")
    stitched = F.concat(F.lit(PASSAGES_INTRO), F.array_join(F.transform("p", lambda s: s["t"]), "\n"))
    cites = F.transform("p", lambda s: F.struct(s["n"].alias("n"), s["label"].alias("label")))
    return joined.select(
        "q_id", "question", F.coalesce(stitched, F.lit(NO_PASSAGES)).alias("answer"),
        F.coalesce(cites, F.array().cast("array<struct<n:int,label:string>>")).alias("citations"))


def answer_with_model(questions: DataFrame, hits: DataFrame, answerer: models.Answerer,
                      per_q: int = ranking.TOP_K, guard: str = GUARD) -> DataFrame:
    """As above, with a model answering from the joined passages of each question."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("n"), "label", F.col("text").alias("t"))))
    found = _cited(hits, per_q).groupBy("q_id").agg(rows.alias("p"))
    context = F.array_join(F.transform("p", lambda s: s["t"]), "\n\n")
    cites = F.transform("p", lambda s: F.struct(s["n"].alias("n"), s["label"].alias("label")))
    asked = tx.with_instruction(F.col("question"), guard)
    return questions.join(found, "q_id", "left").select(
        "q_id", "question", answerer(F.coalesce(context, F.lit("")), asked).alias("answer"), cites.alias("citations"))


def report_blocks(day: str, answers: DataFrame, theme: str = "redux", layout: str = "fixed") -> DataFrame:
    """``part, pos, block`` rows of the daily report; concatenated in order they are the page."""
    spark = answers.sparkSession
    numbered = ordered.number_rows(ordered.arrange(answers, "q_id"), name="idx")
    body = numbered.select(F.lit(1).alias("part"), F.col("idx").cast("bigint").alias("pos"), F.concat(
        F.lit("## Q"), F.col("idx").cast("string"), F.lit(". "), "question", F.lit("\n\n"), "answer", F.lit("\n")).alias("block"))
    fixed = spark.range(1).select(F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.lit(FRONT_MATTER % (theme, layout, day)).alias("block")),
        F.struct(F.lit(2).alias("part"), F.lit(SOURCES_HEAD).alias("block")))).alias("s")).select(
        "s.part", F.lit(0).cast("bigint").alias("pos"), "s.block")
    cites = answers.select("q_id", F.explode("citations").alias("c")).select("q_id", "c.n", "c.label")
    notes = ranking.footnotes(cites).select(F.lit(3).alias("part"), F.col("n").cast("bigint").alias("pos"), F.concat(
        F.lit("[^"), F.col("n").cast("string"), F.lit("]: "), "label", F.lit("\n")).alias("block"))
    return body.unionByName(fixed).unionByName(notes)


def empty_report(spark, day: str, theme: str = "redux", layout: str = "fixed") -> DataFrame:
    """The page of a day without notes."""
    text = FRONT_MATTER % (theme, layout, day) + NO_NOTES
    return spark.range(1).select(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("pos"), F.lit(text).alias("block"))


def audit(corpus: DataFrame, embedder: models.Embedder, samples: int | None = None, seed: int = 0) -> DataFrame:
    """Embed again and compare: ``n_sampled, n_different`` (all rows unless ``samples`` is set)."""
    chosen = corpus if samples is None else corpus.orderBy(F.rand(seed)).limit(samples)
    again = chosen.withColumn("_again", embedder(F.col("text")))
    gap = F.array_max(F.zip_with("embedding", "_again", lambda x, y: F.abs(x - y)))
    return again.agg(F.count(F.lit(1)).alias("n_sampled"), F.count_if(gap > 1e-6).alias("n_different"))
