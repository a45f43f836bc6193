"""Windowed totals of a stream, and an upsert of micro-batches that can be replayed.

A batch and a stream share :func:`tumbling`. :func:`upsert_batches` keeps one folder per micro-batch, overwritten when
the batch runs again after a failure, so nothing is counted twice. :func:`windows_to` adds windows as they close.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def tumbling(events: DataFrame, opened: Column, by: list[str], value: str) -> DataFrame:
    """``n`` and ``total`` of each group and window; ``opened`` gives the window's start."""
    return events.groupBy(*by, opened.alias("opened")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def watermarked(stream: DataFrame, stamp: str, late: str, width: str, by: list[str], value: str) -> DataFrame:
    """Windows of ``width`` over a stream; rows later than ``late`` are dropped and closed windows leave the state."""
    rows = stream.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, late)
    return rows.groupBy(*by, F.window(stamp, width).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(*by, F.col("w.start").alias("opened"), "n", "total")


def upsert_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes each micro-batch to its own folder below ``path`` and stops when the source is read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows_to(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that adds windows to ``path`` as they close and stops when the source is read."""
    return windows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
