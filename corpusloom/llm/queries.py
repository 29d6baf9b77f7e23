"""Queries of this subpackage: name -> function of (spark, sf_dir), and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import collocations, katz, langid, mixing, packing, paragraphs, perplexity, probminhash, quality, radix, resampling, vafile, warc
from corpusloom.llm.common import remainder
from corpusloom.sources.tables import spread_scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return katz.katz_scores(docs, remainder(F.col("doc_id"), 7) == 2).drop("chunk", "place")


@query
def op5_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.perplexity_rules(table(spark, sf_dir, "documents"))


@query
def op2_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_paragraph_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(table(spark, sf_dir, "documents"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)
    return langid.predict_languages(docs, ~F.col("held_out")).select("doc_id", "held_out", "lang_pred", "score")


@query
def op8_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.quality_scores(docs, labels, remainder(F.col("doc_id"), 4) == 2)


@query
def op7_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op1_vector_approximation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_products(table(spark, sf_dir, "embeddings"))


SQL["op1_vector_approximation"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5
"""


@query
def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op6_warc_revisits"] = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
     d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('{warc.BASE32}',
               (((('0x' || substr(h, 1 + 5 * (i // 4)::BIGINT, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f
"""


@query
def op10_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


SQL["op10_pfair_mixing"] = mixing.SQL


@query
def op11_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_scan(spark, f"{sf_dir}/documents.parquet")
    return resampling.resampled(docs, table(spark, sf_dir, "benchmark"))


SQL["op11_crc_resampling"] = resampling.SQL


@query
def op12_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix.exact_duplicates(table(spark, sf_dir, "documents"))


SQL["op12_radix_dedup"] = radix.SQL


@query
def op13_misra_gries_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spread_scan(spark, f"{sf_dir}/documents.parquet"))


SQL["op13_misra_gries_phrases"] = collocations.SQL
