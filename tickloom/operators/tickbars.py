"""Bars of ticks that close by traded volume, value or net flow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import pieces
from tickloom.functions.kernels import VolumeMap, flow_bars, volume_bars
from tickloom.functions.scans import handed_over


def tick_bars(ticks: DataFrame, method: str, threshold: float, side: str = "either", carry_over: bool = False, by_value: bool = False, rows: int | None = None) -> DataFrame:
    """Bars from ticks (symbol, ts, event_id, price, qty, is_buyer_maker).

    ``method``: volume (``side``: buy, sell or either) or netflow (``side``: abs, pos or
    neg). ``by_value`` measures price times quantity. The last bar of a symbol may be
    partial. Ticks are numbered by hours and dealt in pieces of ``rows``; what a piece leaves open is
    handed to the next one. The bars are one native aggregation.
    """
    rows = pieces.ROWS if rows is None else rows
    label = {"volume": volume_bars, "netflow": flow_bars}[method]
    size = F.col("price") * F.col("qty") if by_value else F.col("qty")
    sides = ticks.withColumns({"buy": F.when(~F.col("is_buyer_maker"), size).otherwise(0.0), "sell": F.when(F.col("is_buyer_maker"), size).otherwise(0.0)})

    def run(g: pd.DataFrame, state: tuple) -> tuple[dict[str, np.ndarray], tuple]:
        way, after = label(g["buy"].to_numpy(float), g["sell"].to_numpy(float), threshold, side, carry_over, state)
        return {"way": way}, after

    placed = pieces.numbered(sides, ("ts", "event_id"), F.date_trunc("hour", "ts"), "_tick")
    steps = (lambda: VolumeMap(threshold, side)) if method == "volume" and not carry_over else None
    closed = handed_over(placed, {"way": "long"}, run, (0.0, 0.0), rows, number="_tick", steps=steps, fed=("buy", "sell"))
    closed = pieces.written(closed, "ticks").withColumn("_closes", F.when(F.col("way") != 0, 1).otherwise(0))
    counted = pieces.running(closed, {"_closed": ("sum", "_closes")}, rows, number="_tick")
    # a closing tick belongs to the bar that it closes
    numbered = counted.withColumn("candle_id", (F.col("_closed") - F.col("_closes")).cast("long"))
    seq = F.struct("ts", "event_id")
    bars = numbered.groupBy("symbol", "candle_id").agg(
        F.min_by("price", seq).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", seq).alias("close"), F.sum("buy").alias("buy_volume"), F.sum("sell").alias("sell_volume"),
        F.count("*").alias("n_ticks"), F.min("ts").alias("open_time"), F.max("ts").alias("close_time"), F.sum("way").alias("direction"),
    )
    return bars.withColumns({"volume": F.col("buy_volume") + F.col("sell_volume"), "duration_s": F.expr("timestampdiff(MICROSECOND, open_time, close_time)") / 1e6})
