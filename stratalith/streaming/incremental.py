"""Incremental jobs as Structured Streaming: polled folders, bounded buffers, resumable logs.

Windowed counts with watermarks are an addition of this package.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sets import replay_buffer


def polled(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as they come; each is read once."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def append_log(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to Parquet; with its checkpoint, a restart goes on where it stopped."""
    w = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 minutes")).start()


def buffered(stream: DataFrame, out: str, checkpoint: str, key: str, most: int) -> StreamingQuery:
    """Keep a bounded replay buffer: each batch first, older rows in a hashed order. Versions are written side by side, the last complete one counts."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = None
        if epoch:
            old = spark.read.parquet(f"{out}/version={epoch - 1}")
        new = batch if old is None else replay_buffer(batch, old.select(batch.columns), key, most)
        (new if old is not None else replay_buffer(batch, batch.limit(0), key, most)).write.mode("overwrite").parquet(f"{out}/version={epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n")).select("window.start", key, "n")
