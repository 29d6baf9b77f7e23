"""Incremental ingest with Structured Streaming.

The checkpoint remembers which files were read, so every file is taken once;
the sink is idempotent by id, so a repeated micro-batch or a re-delivered
record changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom import schemas
from corpusloom.functions import models
from corpusloom.operators import store
from corpusloom.plans import ingest
from corpusloom.sources import concatenated, day_files


def record_stream(spark: SparkSession, folder: str, max_files: int | None = None,
                  glob: str = day_files.FILE_GLOB) -> DataFrame:
    """Records of new day files; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(schemas.RECORD).option("mode", "DROPMALFORMED").option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    name = F.col("_metadata.file_name")
    return reader.json(folder).select("*", name.alias("fname"), day_files.day_of_file(name).alias("day"))


def start_concatenated(spark: SparkSession, folder: str, checkpoint: str, take: Callable[[DataFrame, int], None],
                       max_files: int | None = None) -> StreamingQuery:
    """Records of new files whose objects need no line breaks between them, micro-batch by micro-batch.

    Files are read in byte ranges by many tasks; ``take(records, batch number)``
    must be idempotent by record, because an interrupted micro-batch comes again.
    """
    def on_batch(pieces: DataFrame, number: int) -> None:
        take(concatenated.records_of(concatenated.split_pieces(pieces)[0]), number)

    stream = concatenated.piece_stream(spark, folder, max_files)
    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_ingest(records: DataFrame, collection: store.Collection, checkpoint: str, embedder: models.Embedder,
                 **options) -> StreamingQuery:
    """Run the ingest chain on every micro-batch until the input is used up."""
    def on_batch(batch: DataFrame, _epoch: int) -> None:
        if not batch.isEmpty():
            ingest.ingest_records(batch, collection, embedder=embedder, **options)

    return (records.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def distinct_stream(records: DataFrame, key: str = "id", time_col: str | None = None, horizon: str = "7 days") -> DataFrame:
    """Drop records that are delivered again within ``horizon``; the state forgets older keys.

    Time is the records' own (``time_col``), or else when they arrive.
    """
    if time_col:
        return records.withWatermark(time_col, horizon).dropDuplicatesWithinWatermark([key])
    timed = records.withColumn("_arrived", F.current_timestamp())
    return timed.withWatermark("_arrived", horizon).dropDuplicatesWithinWatermark([key]).drop("_arrived")
