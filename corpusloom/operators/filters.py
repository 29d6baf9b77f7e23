"""Row predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

# Defaults of the guards.
ROLE = "assistant"
MAX_CHARS = 20_000
SIMILARITY_CUTOFF = 0.32
SOFT_MEMBERSHIP = 0.1
MIN_CLUSTER_SIZE = 3


def by_role(role: Column, wanted: str = ROLE) -> Column:
    return role == wanted


def non_empty(text: Column) -> Column:
    return F.length(tx.strip(text)) > 0


def multi_line(text: Column) -> Column:
    return F.instr(tx.strip(text), "\n") > 0


def not_too_long(text: Column, limit: int = MAX_CHARS) -> Column:
    return F.length(text) <= limit


def contains_keyword(text: Column, keyword: str) -> Column:
    return F.lower(text).contains(keyword.lower())


def at_or_after(ts_ms: Column, after_ms: int) -> Column:
    """A missing time counts as 0."""
    return ts_ms >= after_ms if after_ms > 0 else F.coalesce(ts_ms, F.lit(0)) >= after_ms


def since(ts: Column, after_ms: int, type_name: str = "timestamp") -> Column:
    """The same on a timestamp column left bare, so that the filter reaches the files."""
    return ts >= F.timestamp_millis(F.lit(after_ms)).cast(type_name)


def by_distance(dist: Column, threshold: float, keep: str = "farther") -> Column:
    """Threshold selection; ``farther`` keeps distances above it, ``nearer`` those up to it."""
    if keep not in ("farther", "nearer"):
        raise ValueError("keep must be 'farther' or 'nearer'")
    return dist > threshold if keep == "farther" else dist <= threshold


def memberships(probabilities: Column, threshold: float = SOFT_MEMBERSHIP) -> Column:
    """Array of component numbers whose probability exceeds the threshold."""
    pairs = F.transform(probabilities, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return F.transform(F.filter(pairs, lambda s: s["x"] > threshold), lambda s: s["i"])


def small_clusters(df: DataFrame, cluster: str = "cluster", min_size: int = MIN_CLUSTER_SIZE) -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < min_size)
