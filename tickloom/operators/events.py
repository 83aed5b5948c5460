"""Event generators: bars in, rows with a direction (+1 or -1) out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.kernels import cusum
from tickloom.functions.pieces import split
from tickloom.functions.scans import ewm_std, handed_over
from tickloom.functions.windows import by_bar, lag, pct_change
from tickloom.operators import indicators as ind

EVENT = ["symbol", "bar_id", "open_time", "direction", "entry_price"]


#: Columns of bars that events carry on, so that barriers need not look them up again.
CARRIED = ["sigma", "last_bar"]


def _events(df: DataFrame) -> DataFrame:
    return df.where(F.col("direction") != 0).select(*EVENT, *[c for c in CARRIED if c in df.columns])


def zscore(bars: DataFrame, n: int = 20, threshold: float = 2.0) -> DataFrame:
    """Against moves of more than ``threshold`` deviations from the mean."""
    out = ind.bollinger(bars, n, 2.0)
    z = F.try_divide(F.col("close") - F.col("bb_middle"), (F.col("bb_upper") - F.col("bb_middle")) / 2)
    return _events(out.withColumn("z", z).withColumn("direction", F.when(F.col("z") < -threshold, 1).when(F.col("z") > threshold, -1).otherwise(0)).withColumn("entry_price", F.col("close")))


def volatility_breakout(bars: DataFrame, n: int = 20, k: float = 2.5, volume_factor: float = 1.5) -> DataFrame:
    """Highs or lows beyond the bands on high volume; the fall wins."""
    out = ind.volume_ma(ind.bollinger(bars, n, k), n)
    busy = F.col("volume") > volume_factor * F.col("volume_ma")
    direction = F.when((F.col("low") < F.col("bb_lower")) & busy, -1).when((F.col("high") > F.col("bb_upper")) & busy, 1).otherwise(0)
    return _events(out.withColumn("direction", direction).withColumn("entry_price", F.col("close")))


def band_touch(bars: DataFrame, n: int = 20, k: float = 2.0, mode: str = "reversal") -> DataFrame:
    """Closes at or beyond a band, traded back (reversal) or on (breakout); the lower band wins."""
    sign = -1 if mode == "reversal" else 1
    out = ind.bollinger(bars, n, k)
    direction = F.when(F.col("close") <= F.col("bb_lower"), -sign).when(F.col("close") >= F.col("bb_upper"), sign).otherwise(0)
    return _events(out.withColumn("direction", direction).withColumn("entry_price", F.col("close")))


def level_break(bars: DataFrame, span: int = 20, replacement: str = "include", entry: str = "level") -> DataFrame:
    """Breaks of support (-1, wins) or resistance (+1).

    ``replacement``: whether a level that gives way to another one at a touch counts
    (include), does not (ignore) or counts alone (only). ``entry``: broken level or close.
    """
    out = ind.support_resistance(bars, span).withColumns({"prev_r": lag("resistance"), "prev_s": lag("support")})

    def broken(prev: str, now: str, beyond):
        gone = F.col(prev).isNotNull() & F.col(now).isNull() & beyond
        moved = F.col(prev).isNotNull() & F.col(now).isNotNull() & (F.col(prev) != F.col(now)) & beyond
        return {"ignore": gone, "only": moved, "include": gone | moved}[replacement]

    up, down = broken("prev_r", "resistance", F.col("high") >= F.col("prev_r")), broken("prev_s", "support", F.col("low") <= F.col("prev_s"))
    out = out.withColumn("direction", F.when(down, -1).when(up, 1).otherwise(0))
    price = F.when(F.col("direction") == 1, F.col("prev_r")).otherwise(F.col("prev_s")) if entry == "level" else F.col("close")
    return _events(out.withColumn("entry_price", price))


def cusum_filter(bars: DataFrame, threshold: float | None = None, multiplier: float = 1.0, span: int = 100) -> DataFrame:
    """Symmetric CUSUM over price moves, at a fixed threshold or ``multiplier`` times the
    exponentially weighted deviation of returns."""
    if threshold is not None:
        return _cusum(bars.withColumn("threshold", F.lit(float(threshold))))
    out = split(bars, lambda b: b.withColumn("ret", pct_change("close")), back=1)
    return _cusum(ewm_std(out, "ret", "sd", span, adjust=True).withColumn("threshold", F.col("sd") * multiplier))


#: Rise, fall and last price before a symbol's first bar.
CUSUM_START = (0.0, 0.0, float("nan"))


def cusum_step(g: pd.DataFrame, state: tuple) -> tuple[dict[str, np.ndarray], tuple]:
    """Directions over some bars with a column threshold, and the state after them."""
    way, after = cusum(g["close"].to_numpy(float), g["threshold"].to_numpy(float), state)
    return {"direction": way}, after


def _cusum(bars: DataFrame) -> DataFrame:
    """Events of bars with a column threshold; a null threshold never fires."""
    return _events(handed_over(bars, {"direction": "long"}, cusum_step, CUSUM_START).withColumn("entry_price", F.col("close")))


def cusum_by_table(bars: DataFrame, thresholds: DataFrame, time: str = "open_time") -> DataFrame:
    """Symmetric CUSUM whose threshold at a bar is the last one given up to its time.

    ``thresholds``: symbol, time and threshold. Bars before the first one never fire.
    """
    from tickloom.operators.asof import asof

    return _cusum(asof(bars, thresholds.select("symbol", time, "threshold"), time, "threshold"))


def delayed(events: DataFrame, bars: DataFrame, k: int) -> DataFrame:
    """Events moved ``k`` bars on and priced at the close there; those beyond the end go."""
    later = bars.select("symbol", "bar_id", F.lead("bar_id", k).over(by_bar()).alias("at"), F.lead("open_time", k).over(by_bar()).alias("time"), F.lead("close", k).over(by_bar()).alias("price"))
    return events.join(later, ["symbol", "bar_id"]).where(F.col("at").isNotNull()).select("symbol", F.col("at").alias("bar_id"), F.col("time").alias("open_time"), "direction", F.col("price").alias("entry_price"))
