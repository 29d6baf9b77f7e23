"""Session helpers: lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Largest number of bytes a query-side matrix or lookup may occupy when it is
# shipped to every executor.  Anything bigger takes a shuffled path.
BROADCAST_BYTES = 32 * 1024 * 1024


def get_spark(app: str = "corpusloom", **conf: str) -> SparkSession:
    """A session with the settings the library relies on (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session.

    A cluster names its shared folder in ``spark.checkpoint.dir``; only a
    local session without that setting gets a folder made here.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="corpusloom-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the files.

    A Parquet table rather than a checkpointed RDD: later reads prune columns,
    and the size of the files tells the planner which joins can be broadcast.
    ``rows_per_file`` keeps the files, and so the tasks that read them, small (0: no limit).
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def collect_if_small(df: DataFrame, max_rows: int) -> pd.DataFrame | None:
    """The rows as pandas, or None when there are more than ``max_rows``."""
    rows = df.limit(max_rows + 1).toPandas()
    return None if len(rows) > max_rows else rows


def matrix(column: pd.Series) -> np.ndarray:
    """A list column as a two-dimensional float64 array."""
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))
