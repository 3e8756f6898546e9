"""Scores as streams: windowed summaries and interaction curves that follow appended rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def windowed_summary(events: DataFrame, time: str, by: Sequence[str], value: str, width: str, late: str) -> DataFrame:
    """Count, mean, minimum and maximum of a value in each time window; rows later than ``late`` are dropped with their window's state."""
    window = F.window(F.col(time), width)
    rows = events.withWatermark(time, late).groupBy(window.alias("w"), *by)
    out = rows.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(F.col("w.start").alias("start"), *by, "count", "mean", "min", "max")


def distinct_stream(events: DataFrame, time: str, key: Sequence[str], late: str) -> DataFrame:
    """Each key once, as long as its repeats come within ``late``."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def curve_sink(events: DataFrame, path: str, checkpoint: str, by: Sequence[str], order: str, value: str) -> DataStreamWriter:
    """A writer that appends each batch's scores to ``path``; :func:`voxmill.operators.curves.area_and_final` reads them.

    Batches carry their number: one that is written again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.select(*by, order, value).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
