"""Streaming forms of bar building: watermarked windows over a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars by event-time window; a window closes once the watermark passes it.

    ``ticks``: symbol, ts (timestamp), event_id, price, qty. Works on batches too.
    """
    seq = F.struct("ts", "event_id")
    grouped = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", seq).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", seq).alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("n_ticks")
    )
    return grouped.select("symbol", F.col("w.start").alias("open_time"), "open", "high", "low", "close", "volume", "n_ticks")


def stream_sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of ticks without a pause longer than ``gap``."""
    grouped = ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_ticks"), F.sum("qty").alias("volume"))
    return grouped.select("symbol", F.col("w.start").alias("open_time"), F.col("w.end").alias("close_time"), "n_ticks", "volume")
