"""Event tables as streams: an extension beside the batch operators, with the same results once a stream has ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 16) -> DataFrame:
    """New Parquet files below a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream gets its watermark, which needs times with a zone (the session's); a batch stays as it is."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "2 hours", value: Column | None = None) -> DataFrame:
    """n (and total) by event-time window and keys; rows later than `late` behind the newest are dropped in a stream."""
    source = _timed(events, time, late)
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value is not None else [])
    return source.groupBy(F.window(time, width), *keys).agg(*aggs).select(F.col("window.start").alias("window_start"), *keys, "n", *(["total"] if value is not None else []))


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """key, session_start, session_end, n."""
    source = _timed(events, time, late)
    out = source.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_once(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Handle all that is there in micro-batches, then stop; a restart goes on where the checkpoint says."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def affected(batch: DataFrame, entity_columns: list[str]) -> DataFrame:
    """Distinct entities that a batch touches, to rebuild those only."""
    return batch.select(F.explode(F.array(*(F.col(c).cast("long") for c in entity_columns))).alias("entity")).where("entity is not null").distinct()
