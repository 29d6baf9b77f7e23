"""Stages of the corpus pipeline: documents in, documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import langid, mixing, packing, paragraphs, probminhash
from corpusloom.llm.common import cut, free_name, remainder

LEAST_SCORE = 0.1  # a language scored lower is no language


def identified(docs: DataFrame) -> DataFrame:
    """Documents with a recognised language, which replaces ``lang``; texts that are null or have no letter go."""
    found = langid.predict_languages(docs, remainder(F.col("doc_id"), 4) != 2)
    found = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of every near-duplicate class; rows with a null id stay.

    Of rows that repeat an id and a text one stays.
    """
    own, n, place = (free_name(docs, c) for c in ("id_", "n_", "place_"))
    classes = cut(probminhash.near_duplicates(docs))
    kept = classes.filter("doc_id = class_id").groupBy(F.col("doc_id").alias(own)).agg(F.count(F.lit(1)).alias(n))
    joined = docs.join(kept, docs["doc_id"] == kept[own], "left").drop(own)
    single = joined.filter((F.col(n) == 1) | F.col("doc_id").isNull()).drop(n)
    by = Window.partitionBy("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).orderBy("text")
    several = joined.filter(F.col(n) > 1).drop(n).withColumn(place, F.row_number().over(by)).filter(F.col(place) == 1).drop(place)
    return single.union(several)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return paragraphs.without_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_schedule_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences numbered in the order in which the stage before stored the documents, so readers meet its mixture."""
    import public_tokenizers

    return packing.packed_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"), place=mixing.stored_place(docs))
