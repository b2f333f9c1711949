"""Structured Streaming versions of the incremental operators: the same semantics on tables that keep arriving.

All run on a batch frame too (streaming-only calls are skipped there), so that both can be compared.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlens.functions import text as T


def _watermark(df: DataFrame, time: str, delay: str) -> DataFrame:
    return df.withWatermark(time, delay) if df.isStreaming else df


def first_copies(df: DataFrame, text: str, time: str, delay: str = "1 day") -> DataFrame:
    """Rows whose duplicate key hasn't been seen within the delay; state is dropped behind the watermark."""
    keyed = _watermark(df.withColumn("dup_key", T.duplicate_key(F.col(text))), time, delay)
    return keyed.dropDuplicatesWithinWatermark(["dup_key"]) if df.isStreaming else keyed.dropDuplicates(["dup_key"])


def gap_sessions(df: DataFrame, keys: Sequence[str], time: str, gap: str, value: str, delay: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap: start, end, pieces and summed value."""
    grouped = _watermark(df, time, delay).groupBy(*keys, F.session_window(time, gap).alias("w"))
    return grouped.agg(F.count("*").alias("pieces"), F.round(F.sum(value), 6).alias("total")).select(*keys, F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "pieces", "total")


def windowed_counts(df: DataFrame, keys: Sequence[str], time: str, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows per tumbling or sliding window."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return _watermark(df, time, delay).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("opened"), *keys, "n")


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes a stream as parquet, exactly once by its checkpoint; takes what is there and stops."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def each_batch(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update"):
    """Hands every micro-batch to a function (an upsert, say)."""
    return df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
