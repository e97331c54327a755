"""Append-only intake: new page rows or files reach the library in micro-batches.

Each batch is a segment of its own, so it costs what it holds, beside a look at the narrow manifest (path, time, size).
A file source notices new files only; changed or vanished ones need a batch update (``Library.update_from_files``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.library import Library


def pages_stream(spark, folder: str) -> DataFrame:
    """A stream of (path, mtime, size, pages) from Parquet files that arrive in a folder."""
    return spark.readStream.schema("path string, mtime double, size long, pages array<string>").parquet(folder)


def take_in(library: Library, batch: DataFrame, epoch: int) -> None:
    """Add a batch; rows that the library already has unchanged are skipped, so a batch that runs twice adds nothing."""
    if not batch.isEmpty():
        library.add(batch)


def start(stream: DataFrame, library: Library, checkpoint: str):
    """Take in what is there now, then stop."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: take_in(library, batch, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Intake counts by time window, late rows up to ``late`` included."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n"))
