"""Documents as a stream: new files are parsed as they come, and events feed page-like counts with late data handled.

All operators work on one document at a time, so a stream needs no state for them: each micro-batch goes through the same
DataFrame functions as a batch would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime, content of files as they appear."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)


def run_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """``work`` of each micro-batch, written as Parquet under its batch number: a batch that runs again replaces its own files."""

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", wide: str = "1 hour") -> DataFrame:
    """Counts and sums of events by window and type; events later than ``late`` behind the newest are left out when streamed."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", wide), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )
