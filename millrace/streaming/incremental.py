"""Incremental batches on Structured Streaming: idempotent appends and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.sinks import append_new


def append_stream(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str):
    """Folds a stream into an append-only table; a batch that is replayed adds nothing."""

    def fold(batch: DataFrame, _: int) -> None:
        append_new(batch, path, keys, [F.col(c) for c in order])

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event type and tumbling window; works on tables and streams alike."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", every).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )
