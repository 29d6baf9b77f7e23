"""The catalog of runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from corpusloom.sources.tables import spread_scan

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: QueryFn
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under ``name``; ``covers`` lists the inventory rows it shows."""
    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, covers, fn, sql)
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread over all cores for work on whole texts."""
    return spread_scan(spark, f"{sf_dir}/documents.parquet")


# SQL fragments for DuckDB.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LB = r"(?:\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}])"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def normalize(x: str) -> str:
    return f"regexp_replace({strip(x)}, '{WS}+', ' ', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def clean(x: str) -> str:
    return f"regexp_replace(replace({strip(x)}, '...', '…'), ' {{2,}}', ' ', 'g')"


def tokens(x: str) -> str:
    return f"(CASE WHEN length({x}) = 0 THEN 0 ELSE greatest(1, (length({x}) + 3) // 4) END)::BIGINT"


def shorten(x: str, width: int, placeholder: str) -> str:
    flat, room = normalize(x), width - len(placeholder)
    head = f"regexp_extract(substr({flat}, 1, {room + 1}), '^(.+) ', 1)"
    return (f"CASE WHEN length({flat}) <= {width} THEN {flat} WHEN {head} = '' THEN '{placeholder.lstrip()}' "
            f"ELSE {head} || '{placeholder}' END")


def flat(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{LB}\\z', ''), '{LB}', ' ', 'g')"


def hash_vectors(name: str, source: str, key: str, text: str = "text", dim: int = 64) -> str:
    """CTEs: ``{name}_s(key, b, v)`` sparse and ``{name}_n(key, nn)`` norms of hash embeddings."""
    return f"""
    {name}_c AS (SELECT {key}, b, count(*) n FROM (
        SELECT {key}, ('0x' || substr(md5(w), 1, 8))::UBIGINT % {dim} b
        FROM (SELECT {key}, unnest({words(f'lower({text})')}) w FROM {source})) GROUP BY ALL),
    {name}_l AS (SELECT {key}, sqrt(sum(n * n)) nn FROM {name}_c GROUP BY {key}),
    {name}_s AS (SELECT {key}, b, (n / (nn + 1e-9))::FLOAT::DOUBLE v FROM {name}_c JOIN {name}_l USING ({key})),
    {name}_n AS (SELECT {key}, sqrt(sum(v * v)) nn FROM {name}_s GROUP BY {key})"""
