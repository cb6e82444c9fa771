"""Structured Streaming forms: change feeds applied batch by batch, windowed counts with a watermark, running EWMA."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per tumbling window and key; on a stream, rows later than the watermark are left out and state is freed."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark(time, late)
    counts = stamped.groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), key, "n")


def session_counts(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Rows per session: runs of a key's events with no gap of that length."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark(time, late)
    counts = stamped.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("session_start"), key, "n")


def apply_batches(changes: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]):
    """Start a query that hands each micro-batch to apply with its number. A batch may come again after a failure:
    apply must write by number, as `versioned_writer` does."""
    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply).trigger(availableNow=True).start()


def versioned_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writes batch n to path/batch=n, replacing what an earlier try left: applying a batch twice changes nothing."""

    def write(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return write


def latest_cells(feed: DataFrame) -> DataFrame:
    """The current value of each cell of a change feed (row_key, col, kind, value, batch): the last change wins."""
    last = feed.groupBy("row_key", "col").agg(F.max_by(F.struct("kind", "value"), "batch").alias("c"))
    return last.where("c.kind <> 'delete'").select("row_key", "col", F.col("c.value").alias("value"))


def running_ewma(readings: DataFrame, key: str, value: str, lam: float = 0.3) -> DataFrame:
    """(key, n, ewma) per micro-batch with state: the smoothed value of each key over all batches so far."""

    def update(k: tuple, frames, state):
        n, z = state.get if state.exists else (0, 0.0)
        for f in frames:
            for x in f.sort_values(list(f.columns))[value]:
                z, n = (float(x) if n == 0 else lam * float(x) + (1 - lam) * z), n + 1
        state.update((n, z))
        yield pd.DataFrame({key: [k[0]], "n": [n], "ewma": [z]})

    kind = readings.schema[key].dataType.simpleString()
    return readings.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, ewma double", "n long, z double", "update", "NoTimeout")
