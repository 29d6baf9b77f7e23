"""A chain of corpus operators: each stage reads the documents that its predecessor wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import stages
from corpusloom.session import ensure_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", stages.language),
    ("near_duplicates", stages.near_duplicates),
    ("repeats", stages.repeats),
    ("mixed", stages.mixed),
    ("packed", stages.packed),
]
ORACLE_SQL: str | None = None  # kernels, signatures and tokens have no SQL form; tests/llm holds the brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; every result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}")
    return docs
