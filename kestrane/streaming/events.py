"""Events as a stream: hourly windows with late data, and batches merged into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Event files as they arrive in a folder."""
    reader = spark.readStream.schema(EVENTS)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(folder)


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(window, event_type, n, total); on a stream, events later than `late` are left out and state is dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def merge_batches(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each micro-batch to `merge` until the input at hand is used up."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
