"""Streaming counterparts: continuous aggregates over tumbling windows, and change feeds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def continuous_aggregate(stream: DataFrame, ts: str, width: str, lateness: str, by: Sequence[str], aggregates: dict[str, Column], unique: Sequence[str] = ()) -> DataFrame:
    """Aggregates per tumbling window; rows later than `lateness` are left out, and so bound the state. With `unique`,
    rows that repeat those columns (and time) within the lateness count once."""
    rows = stream.withWatermark(ts, lateness)
    if unique:
        rows = rows.dropDuplicatesWithinWatermark(list(unique))
    grouped = rows.groupBy(F.window(ts, width).alias("__w"), *by).agg(*[a.alias(n) for n, a in aggregates.items()])
    return grouped.select(F.col("__w.start").alias("bucket"), *by, *aggregates)


def change_feed(stream: DataFrame, emit: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Hands each batch of changes to `emit`; batches are replayed after a failure, so `emit` goes by the batch's number."""
    return stream.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
