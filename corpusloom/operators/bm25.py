"""BM25 scores of hits, with document frequencies and lengths from one pass over the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import ranking

# The usual saturation and length weights.
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    return tx.words(F.lower(F.coalesce(text, F.lit(""))))


def statistics(corpus: DataFrame, asked: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``term, df`` of the terms in ``asked(term)``, and one row ``n_docs, mean_length``.

    Each document gives its distinct terms and, under a null term, its length;
    both are counted in the same pass, combined before the shuffle.
    """
    words = terms(F.col(text))
    row = lambda term, length: F.struct(term.alias("term"), length.cast("bigint").alias("length"))
    own = F.transform(F.array_distinct("w"), lambda t: row(t, F.lit(0)))
    cells = corpus.select(words.alias("w")).select(F.explode(F.concat(F.array(row(F.lit(None).cast("string"), F.size("w"))), own)).alias("c")).select("c.*")
    # Terms that nobody asks for are dropped by the join; it is broadcast where the questions are few.
    needed = asked.select("term").distinct().unionByName(asked.sparkSession.createDataFrame([(None,)], "term string"))
    counted = cells.join(needed.withColumnRenamed("term", "_t"), F.col("term").eqNullSafe(F.col("_t")), "left_semi").groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("length").alias("length"))
    whole = counted.where("term is null").select(F.col("df").alias("n_docs"), (F.col("length") / F.col("df")).alias("mean_length"))
    return counted.where("term is not null").select("term", "df"), whole


def scores(hits: DataFrame, questions: DataFrame, corpus: DataFrame, question: str = "question", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """``hits(q_id, ..., text)`` with their ``bm25``; the corpus only gives the statistics."""
    asked = questions.select("q_id", F.explode(F.array_distinct(terms(F.col(question)))).alias("term"))
    df, whole = statistics(corpus, asked, text)
    whole = F.broadcast(whole)  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, "term").crossJoin(whole).groupBy("q_id").agg(
        F.array_sort(F.collect_list(F.struct("term", idf.alias("idf")))).alias("_q"), F.first("mean_length").alias("_mean"))
    found = hits.join(weighed, "q_id", "left").withColumn("_w", terms(F.col(text)))
    norm = k1 * (1 - b + b * F.size("_w") / F.col("_mean"))

    def add(acc: Column, t: Column) -> Column:
        tf = F.size(F.filter("_w", lambda w: w == t["term"]))
        return acc + t["idf"] * tf * (k1 + 1) / (tf + norm)

    return found.withColumn("bm25", F.coalesce(F.aggregate("_q", F.lit(0.0), add), F.lit(0.0))).drop("_q", "_mean", "_w")


def rerank(hits: DataFrame, questions: DataFrame, corpus: DataFrame, top_n: int, question: str = "question") -> DataFrame:
    """Hits ranked anew by BM25, the first ``top_n`` kept: ``rerank_score`` as by ``ranking.rerank``."""
    return ranking.rerank(scores(hits, questions, corpus, question), F.col("bm25"), top_n).drop("bm25")
