"""Indicators over bars: each takes bars and returns them with new columns.

Only what needs a window over another window is a stage of its own; all windows
share one partitioning, so a chain of indicators shuffles once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.pieces import split
from tickloom.functions.scans import ewm_mean
from tickloom.functions.windows import EPS, ahead, behind, clip, lag, mean_abs_deviation, rolling, running, values


def sma(bars: DataFrame, n: int = 20, column: str = "close") -> DataFrame:
    """Mean of the last n bars, or of all so far if fewer."""
    return bars.withColumn(f"sma_{n}", rolling(F.avg, column, n, 1))


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, column: str = "close") -> DataFrame:
    """Mean and bands k sample deviations around it."""
    mid, dev = rolling(F.avg, column, n), rolling(F.stddev_samp, column, n)
    return bars.withColumns({"bb_middle": mid, "bb_upper": mid + k * dev, "bb_lower": mid - k * dev})


def bollinger_width(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    return bollinger(bars, n, k).withColumn("bb_width", (F.col("bb_upper") - F.col("bb_lower")) / (F.col("bb_middle") + EPS))


def true_range(bars: DataFrame) -> DataFrame:
    """The largest of high-low and the moves from the last close (first bar: from its middle)."""
    before = F.coalesce(lag("close"), (F.col("high") + F.col("low")) / 2)
    return bars.withColumn("prev_close", before).withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")), F.abs(F.col("low") - F.col("prev_close"))))


def atr(bars: DataFrame, n: int = 14, method: str = "wilder") -> DataFrame:
    """Average true range: Wilder's recurrence (weight 1/n) or a rolling mean."""
    if method == "sma":
        return true_range(bars).withColumn("atr", rolling(F.avg, "tr", n))
    return ewm_mean(split(bars, true_range, back=1), {"atr": ("tr", 1 / n)})


def volatility_ratio(bars: DataFrame, short: int = 5, long: int = 20, n: int = 14) -> DataFrame:
    """Mean of the range over few bars against that over many."""
    out = atr(bars, n, "sma")
    return out.withColumn("volatility_ratio", F.try_divide(rolling(F.avg, "atr", short), rolling(F.avg, "atr", long)))


def rsi(bars: DataFrame, n: int = 14, column: str = "close") -> DataFrame:
    """Relative strength by Wilder's recurrence, from 0 to 100, and over 100."""
    out = split(bars, lambda b: b.withColumn("delta", F.coalesce(F.col(column) - lag(column), F.lit(0.0))), back=1).withColumns({"gain": F.when(F.col("delta") > 0, F.col("delta")).otherwise(0.0), "loss": F.when(F.col("delta") < 0, -F.col("delta")).otherwise(0.0)})
    out = ewm_mean(out, {"avg_gain": ("gain", 1 / n), "avg_loss": ("loss", 1 / n)})
    return out.withColumn("rsi", 100 - 100 / (1 + F.col("avg_gain") / (F.col("avg_loss") + EPS))).withColumn("rsi_norm", F.col("rsi") / 100)


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, column: str = "close") -> DataFrame:
    out = ewm_mean(bars, {"ema_fast": (column, 2 / (fast + 1)), "ema_slow": (column, 2 / (slow + 1))})
    out = ewm_mean(out.withColumn("macd_line", F.col("ema_fast") - F.col("ema_slow")), {"macd_signal": ("macd_line", 2 / (signal + 1))})
    return out.withColumn("macd_hist", F.col("macd_line") - F.col("macd_signal"))


def volume_ma(bars: DataFrame, n: int = 20) -> DataFrame:
    return bars.withColumn("volume_ma", rolling(F.avg, "volume", n))


def vwap_distance(bars: DataFrame) -> DataFrame:
    """Distance of the close from the volume-weighted mean price so far, relative to it."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    vwap = running(F.sum, typical * F.col("volume")) / (running(F.sum, "volume") + EPS)
    return bars.withColumn("vwap", vwap).withColumn("vwap_distance", (F.col("close") - F.col("vwap")) / (F.col("vwap") + EPS))


def normalized_momentum(bars: DataFrame, n_rsi: int = 14, n_stoch: int = 14, n_cci: int = 20) -> DataFrame:
    """RSI over 100, place of the close in the recent range, and channel index over 400."""
    out = rsi(bars, n_rsi).withColumn("typical", (F.col("high") + F.col("low") + F.col("close")) / 3)
    low, high = rolling(F.min, "low", n_stoch), rolling(F.max, "high", n_stoch)
    cci = (F.col("typical") - rolling(F.avg, "typical", n_cci)) / (0.015 * mean_abs_deviation("typical", n_cci) + EPS)
    return out.withColumns({"norm_stoch": (F.col("close") - low) / (high - low + EPS), "norm_cci": cci / 400})


def percent_rank(bars: DataFrame, n: int = 20, column: str = "close") -> DataFrame:
    """Share of the last n values (this one included) that are strictly less."""
    v = values(column, n)
    return bars.withColumn("held", v).withColumn("percent_rank", F.when(F.size("held") == n, F.size(F.filter("held", lambda x: x < F.col(column))) / n)).drop("held")


def support_resistance(bars: DataFrame, span: int = 20, tick: float = 0.01, ticks: int = 2) -> DataFrame:
    """Pivot levels that hold until they are broken, and touches of the band before them.

    A high is a pivot if no high of ``span`` bars on either side exceeds it. Its level
    lasts until a later bar goes beyond it (by more than 1e-8) or a new pivot comes.
    Columns: pivot_high, pivot_low, resistance, support, res_band_hit(s), sup_band_hit(s).
    """
    top = (F.col("high") >= behind(F.max, "high", span)) & (F.col("high") >= ahead(F.max, "high", span))
    bottom = (F.col("low") <= behind(F.min, "low", span)) & (F.col("low") <= ahead(F.min, "low", span))
    out = bars.withColumns({"pivot_high": F.coalesce(top, F.lit(False)), "pivot_low": F.coalesce(bottom, F.lit(False))})
    out = out.withColumns({"seg_high": running(F.sum, F.col("pivot_high").cast("long")), "seg_low": running(F.sum, F.col("pivot_low").cast("long"))})
    for seg, price, level, sign, band in (("seg_high", "high", "resistance", 1, "res"), ("seg_low", "low", "support", -1, "sup")):
        own = Window.partitionBy("symbol", seg).orderBy("bar_id")
        out = out.withColumns({"rn": F.row_number().over(own), "lvl": F.when(F.col(seg) > 0, F.first(price).over(own))})
        beyond = (F.col("rn") > 1) & ((F.col(price) - F.col("lvl")) * sign > 1e-8)
        out = out.withColumn("beyond", F.coalesce(beyond, F.lit(False))).withColumn("broken", F.max("beyond").over(own))
        out = out.withColumn(level, F.when(~F.col("broken"), F.col("lvl")))
        near = F.col(level).isNotNull() & ((F.col(level) - F.col(price)) * sign >= 0) & ((F.col(level) - F.col(price)) * sign <= ticks * tick) & (F.col("rn") > 1)
        out = out.withColumn(f"{band}_band_hit", near).withColumn(f"{band}_band_hits", F.sum(F.col(f"{band}_band_hit").cast("long")).over(own))
    return out.drop("seg_high", "seg_low", "rn", "lvl", "beyond", "broken")


def breakout_gap(bars: DataFrame, span: int = 20, n: int = 14, scale: str = "raw", bound: float = 5.0, shift: int = 0) -> DataFrame:
    """Distance of the close from the levels in average ranges; raw, clipped or through tanh."""
    out = atr(support_resistance(bars, span), n)

    def gap(level: str) -> Column:
        at = lag(level, shift) if shift else F.col(level)
        x = (F.col("close") - at) / (F.col("atr") + EPS)
        return x if scale == "raw" else clip(x, -bound, bound) if scale == "clip" else F.tanh(clip(x, -bound, bound) / (bound + 2))

    return out.withColumns({"gap_resistance": gap("resistance"), "gap_support": gap("support")})


