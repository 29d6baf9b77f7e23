"""Selections over ranked hits: budgets, numbering, footnotes, reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

# Retrieval defaults.
TOP_K = 8
PASSAGES_PER_QUESTION = 5
TOKEN_CAP = 2000
CONTEXT_TOKENS = 3500
TREE_TOP_K = 10


def _running(keys: list[str], rank: str) -> Window:
    return Window.partitionBy(*keys).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def rank_within(df: DataFrame, keys: list[str], k: int, *order: Column, name: str = "rank") -> DataFrame:
    """Numbered first k rows per key (the filter sits on the window, so Spark limits early)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def budget_prefix(hits: DataFrame, tokens: str, budget: int, keys: list[str] = ("q_id",), rank: str = "rank") -> DataFrame:
    """Ranked rows up to the first one that would exceed the budget (may be none)."""
    used = F.sum(tokens).over(_running(list(keys), rank))
    return hits.withColumn("running_tokens", used).where(F.col("running_tokens") <= budget)


def budget_cap(hits: DataFrame, tokens: str, budget: int = TOKEN_CAP, keys: list[str] = ("q_id",), rank: str = "rank") -> DataFrame:
    """As ``budget_prefix`` but rank 1 always stays, and stays alone when it uses the budget up."""
    w = _running(list(keys), rank)
    out = hits.withColumn("running_tokens", F.sum(tokens).over(w)).withColumn("_first", F.first(tokens).over(w))
    return out.where((F.col(rank) == 1) | ((F.col("_first") < budget) & (F.col("running_tokens") <= budget))).drop("_first")


def budget_inclusive(hits: DataFrame, tokens: str, max_context: int, max_tokens: int, keys: list[str] = ("q_id",), rank: str = "rank") -> DataFrame:
    """The row that overflows is still included; at most ``max_context // max_tokens`` rows."""
    before = F.col("running_tokens") - F.col(tokens)
    return hits.withColumn("running_tokens", F.sum(tokens).over(_running(list(keys), rank))).where(
        (F.col(rank) <= max_context // max_tokens) & (before <= max_context))


def footnotes(citations: DataFrame, question: str = "q_id", number: str = "n", label: str = "label",
              restart: bool = True) -> DataFrame:
    """``n, label`` of the source list.

    Numbers restart with every question, so the first question that uses a
    number names it.  ``restart=False`` numbers all citations through.
    """
    if restart:
        return citations.groupBy(number).agg(F.min_by(label, question).alias(label))
    from corpusloom.operators.ordered import arrange, number_rows
    placed = arrange(citations.select(question, number, label), question, number)
    return number_rows(placed, name="_n").select(F.col("_n").alias(number), label)


def rerank(hits: DataFrame, score: Column, top_n: int, keys: list[str] = ("q_id",), item: str = "id") -> DataFrame:
    """Second score, new ranks by it, first ``top_n`` kept."""
    scored = hits.drop("rank").withColumn("rerank_score", F.round(score, 6))
    return rank_within(scored, list(keys), top_n, F.desc("rerank_score"), F.desc("score"), F.asc(item))


def postprocess(hits: DataFrame, steps: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply a chain of DataFrame to DataFrame steps."""
    for step in steps:
        hits = hits.transform(step)
    return hits


def dedup_in_order(df: DataFrame, key: str, pos: str, keys: list[str] = ()) -> DataFrame:
    """Each value once, at its first position."""
    return df.groupBy(*keys, key).agg(F.min(pos).alias(pos))


def context_text(selected: DataFrame, keys: list[str] = ("q_id",), rank: str = "rank", text: str = "text") -> DataFrame:
    """Ordered concatenation of the selected texts, lines flattened, blank line after each.

    The selection is bounded (top k or a token budget), so the row is too.
    """
    block = F.concat(tx.flatten_lines(F.col(text)), F.lit("\n\n"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("t"))))
    return selected.groupBy(*keys).agg(
        F.array_join(F.transform(rows, lambda s: s["t"]), "").alias("context"), F.count(F.lit(1)).alias("n_selected"))


def context_parts(selected: DataFrame, keys: list[str], order: list[str], text: str = "text", rows_per_part: int = 1000) -> DataFrame:
    """As ``context_text`` for selections of any size: ``keys, part, context, n_selected`` in ordered parts."""
    from corpusloom.operators.ordered import concat_parts
    block = F.concat(tx.flatten_lines(F.col(text)), F.lit("\n\n"))
    parts = concat_parts(selected, list(keys), list(order), block, "", rows_per_part)
    return parts.select(*keys, "part", F.col("text").alias("context"), F.col("n_rows").alias("n_selected"))


def question_metrics(candidates: DataFrame, selected: DataFrame, cutoff: float) -> DataFrame:
    """Per question: candidates, after cutoff, selected, similarity span, selected tokens."""
    a = candidates.groupBy("q_id").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_if(F.col("score") >= cutoff).alias("n_after_cutoff"),
        F.min("score").alias("sim_min"), F.max("score").alias("sim_max"),
    )
    b = selected.groupBy("q_id").agg(
        F.count(F.lit(1)).alias("n_selected"), F.sum("tokens").alias("selected_token_sum"))
    zero = F.lit(0).cast("bigint")
    return a.join(b, "q_id", "left").select(
        "q_id", "n_candidates", "n_after_cutoff", F.coalesce("n_selected", zero).alias("n_selected"),
        "sim_min", "sim_max", F.coalesce("selected_token_sum", zero).alias("selected_token_sum"))
