"""Watching a source of changed files as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILE_EVENTS = "repo string, file_path string, language string, content string, deleted boolean, changed_at timestamp"


def latest(batch: DataFrame) -> DataFrame:
    """The last event of each file: changes of one file within a batch are coalesced."""
    w = Window.partitionBy("repo", "file_path").orderBy(F.desc("changed_at"))
    return batch.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def watch(spark: SparkSession, source: str, checkpoint: str, update: Callable[[DataFrame, int], None], debounce: str = "2 seconds", once: bool = False) -> StreamingQuery:
    """Calls ``update`` with the coalesced changes of each micro-batch.

    The checkpoint records which files of events a batch took, so after a failure the same batch is
    given again with the same number; ``update`` should be idempotent by that number or by content.
    """
    events = spark.readStream.schema(FILE_EVENTS).parquet(source)
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: update(latest(df), n))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=debounce)).start()


def event_counts(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by type and window with a watermark for late ones; works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
