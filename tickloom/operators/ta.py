"""Technical-analysis family with its usual warm-up: null until a full window is there.

Names carry the prefix ``ta_``, since some formulas differ from ``indicators``.
``normalize`` maps results to about 0..1; those that scale by the whole series
(momentum, MACD, bands, OBV, A/D) see all bars of the symbol.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.pieces import split
from tickloom.functions.scans import Affine, recur, seeded, wilder
from tickloom.functions.windows import clip, lag, logistic, mean_abs_deviation, rolling, running, values, whole


def stochastic(bars: DataFrame, n: int = 14, smooth: int = 3, signal: int = 3) -> DataFrame:
    low, high = rolling(F.min, "low", n), rolling(F.max, "high", n)
    out = bars.withColumn("fast_k", F.when(high > low, 100 * (F.col("close") - low) / (high - low)).otherwise(F.when(high.isNotNull(), 0.0)))
    out = out.withColumn("ta_stoch_k", rolling(F.avg, "fast_k", smooth))
    out = out.withColumn("ta_stoch_d", rolling(F.avg, "ta_stoch_k", signal))
    # both lines start together
    return out.withColumns({"ta_stoch_k": F.when(F.col("ta_stoch_d").isNotNull(), F.col("ta_stoch_k")) / 100, "ta_stoch_d": F.col("ta_stoch_d") / 100}).drop("fast_k")


def williams_r(bars: DataFrame, n: int = 14) -> DataFrame:
    low, high = rolling(F.min, "low", n), rolling(F.max, "high", n)
    w = F.when(high > low, -100 * (high - F.col("close")) / (high - low)).otherwise(F.when(high.isNotNull(), 0.0))
    return bars.withColumn("ta_willr", (w + 100) / 100)


def cci(bars: DataFrame, n: int = 14) -> DataFrame:
    out = bars.withColumn("typical", (F.col("high") + F.col("low") + F.col("close")) / 3)
    mad = mean_abs_deviation("typical", n)
    raw = F.when(mad > 0, (F.col("typical") - rolling(F.avg, "typical", n)) / (0.015 * mad)).otherwise(F.when(mad.isNotNull(), 0.0))
    return out.withColumn("ta_cci", logistic(raw / 100)).drop("typical")


def roc(bars: DataFrame, n: int = 10) -> DataFrame:
    return bars.withColumn("ta_roc", logistic((F.try_divide(F.col("close"), lag("close", n)) - 1) * 100 / 10))


def momentum(bars: DataFrame, n: int = 10) -> DataFrame:
    return bars.withColumn("ta_mom", logistic((F.col("close") - lag("close", n)) / (whole(F.avg, "close") * 0.01)))


def aroon(bars: DataFrame, n: int = 14) -> DataFrame:
    """100*(n - bars since the latest extreme)/n over n+1 bars, over 100."""
    highs, lows = F.reverse(values("high", n + 1)), F.reverse(values("low", n + 1))
    out = bars.withColumns({"highs": highs, "lows": lows})
    since = lambda v, f: F.array_position(v, f(v)) - 1
    full = F.size("highs") == n + 1
    return out.withColumns({"ta_aroon_up": F.when(full, (n - since(F.col("highs"), F.array_max)) / n), "ta_aroon_down": F.when(full, (n - since(F.col("lows"), F.array_min)) / n)}).drop("highs", "lows")


def bands(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Bands by population deviation; position of the close in them; bands around the series' mean."""
    mid, dev = rolling(F.avg, "close", n), rolling(F.stddev_pop, "close", n)
    out = bars.withColumns({"mid": mid, "up": mid + k * dev, "low_": mid - k * dev, "mean_": whole(F.avg, "close")})
    near = lambda c: logistic(10 * (F.col(c) - F.col("mean_")) / F.col("mean_"))
    return out.withColumns({"ta_bb_percent": F.try_divide(F.col("close") - F.col("low_"), F.col("up") - F.col("low_")), "ta_bb_upper": near("up"), "ta_bb_middle": near("mid"), "ta_bb_lower": near("low_")}).drop("mid", "up", "low_", "mean_")


def stddev(bars: DataFrame, n: int = 20) -> DataFrame:
    return bars.withColumn("ta_stddev", clip(F.try_divide(rolling(F.stddev_pop, "close", n), F.col("close")), 0.0, 0.1) / 0.1)


def _scaled(df: DataFrame, column: str, name: str) -> DataFrame:
    low, high = whole(F.min, column), whole(F.max, column)
    return df.withColumn(name, F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(0.0)).drop(column)


def obv(bars: DataFrame) -> DataFrame:
    """Volume signed by the move of the close, summed from the first bar's volume; scaled to 0..1."""
    step = F.when(lag("close").isNull(), F.col("volume")).otherwise(F.signum(F.col("close") - lag("close")) * F.col("volume"))
    return _scaled(bars.withColumn("step", step).withColumn("obv", running(F.sum, "step")).drop("step"), "obv", "ta_obv")


def _flow_share() -> Column:
    span = F.col("high") - F.col("low")
    return F.when(span > 0, ((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / span).otherwise(0.0)


def accumulation(bars: DataFrame) -> DataFrame:
    return _scaled(bars.withColumn("ad", running(F.sum, _flow_share() * F.col("volume"))), "ad", "ta_ad")


def money_flow(bars: DataFrame, n: int = 20) -> DataFrame:
    flow = F.try_divide(rolling(F.sum, _flow_share() * F.col("volume"), n), rolling(F.sum, "volume", n))
    return bars.withColumn("ta_cmf", clip((flow + 1) / 2, 0.0, 1.0))


def mfi(bars: DataFrame, n: int = 14) -> DataFrame:
    out = bars.withColumn("typical", (F.col("high") + F.col("low") + F.col("close")) / 3).withColumn("move", F.col("typical") - lag("typical"))
    flow = F.col("typical") * F.col("volume")
    up, down = (rolling(F.sum, F.when(F.col("move").isNotNull(), F.when(c, flow).otherwise(0.0)), n) for c in (F.col("move") > 0, F.col("move") < 0))
    return out.withColumn("ta_mfi", F.when(up + down > 0, up / (up + down)).otherwise(F.when(up.isNotNull(), 0.0))).drop("typical", "move")


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    out = split(bars, lambda b: b.withColumn("move", F.col("close") - lag("close")).withColumns({"up": F.greatest(F.col("move"), F.lit(0.0)), "down": F.greatest(-F.col("move"), F.lit(0.0))}), back=1)
    out = recur(out.withColumns({c: F.when(F.col("move").isNotNull(), F.col(c)) for c in ("up", "down")}), {"up_": ("up", wilder(n)), "down_": ("down", wilder(n))})
    total = F.col("up_") + F.col("down_")
    return out.withColumn("ta_rsi", F.when(total > 0, F.col("up_") / total).when(total.isNotNull(), 0.0)).drop("move", "up", "down", "up_", "down_")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Both means start at bar ``slow`` - 1; scaled by the range of the series."""
    out = recur(bars, {"fast_": ("close", seeded(fast, slow - 1)), "slow_": ("close", seeded(slow))}).withColumn("line_", F.col("fast_") - F.col("slow_"))
    out = recur(out, {"signal_": ("line_", seeded(signal))})
    range_ = bars.groupBy("symbol").agg(((F.max("close") - F.min("close")) * 0.01).alias("range_"))
    out = out.join(range_, "symbol")
    scaled = lambda x: F.when(F.col("signal_").isNotNull(), logistic(F.try_divide(x, F.col("range_"))))
    line, sig = F.col("line_"), F.col("signal_")
    return out.withColumns({"ta_macd": scaled(line), "ta_macd_signal": scaled(sig), "ta_macd_hist": scaled(line - sig)}).drop("fast_", "slow_", "line_", "signal_", "range_")


def _with_true_range(bars: DataFrame) -> DataFrame:
    """The largest of high-low and the moves from the last close; null at the first bar."""
    before = lag("close")
    spread = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return bars.withColumn("tr_", F.when(before.isNotNull(), spread))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    out = recur(split(bars, _with_true_range, back=1), {"atr_": ("tr_", wilder(n))})
    return out.withColumn("ta_atr", clip(F.try_divide(F.col("atr_"), F.col("close")), 0.0, 0.1) / 0.1).drop("tr_", "atr_")


def _directional_sum(n: int) -> Affine:
    """Sum of the values from number 1 to n - 1, then less its n-th part plus each value."""
    return Affine(lambda x, i: (np.where(i < n, 1.0, 1 - 1 / n), np.where(i < 1, 0.0, x)), shown=n)


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """Directional movement: sums smoothed by Wilder from n-1 moves on; index over n values."""

    def moves(b: DataFrame) -> DataFrame:
        up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
        return _with_true_range(b).withColumns({"tr_": F.coalesce("tr_", F.lit(0.0)), "plus_": F.when((up > down) & (up > 0), up).otherwise(0.0), "minus_": F.when((down > up) & (down > 0), down).otherwise(0.0)})

    own = _directional_sum(n)
    out = recur(split(bars, moves, back=1), {"tr_sum": ("tr_", own), "plus_sum": ("plus_", own), "minus_sum": ("minus_", own)})
    share = lambda c: F.when(F.col("tr_sum") > 0, 100 * F.col(c) / F.col("tr_sum")).when(F.col("tr_sum").isNotNull(), 0.0)
    out = out.withColumns({"plus_di": share("plus_sum"), "minus_di": share("minus_sum")})
    both = F.col("plus_di") + F.col("minus_di")
    out = out.withColumn("dx_", F.when(both > 0, 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / both).when(both.isNotNull(), 0.0))
    out = recur(out, {"adx_": ("dx_", wilder(n))})
    return out.withColumns({"ta_adx": F.col("adx_") / 100, "ta_plus_di": F.col("plus_di") / 100, "ta_minus_di": F.col("minus_di") / 100}).drop("tr_", "plus_", "minus_", "tr_sum", "plus_sum", "minus_sum", "plus_di", "minus_di", "dx_", "adx_")


def trix(bars: DataFrame, n: int = 30) -> DataFrame:
    out = bars.withColumn("e0_", F.col("close"))
    for k in range(3):
        out = recur(out, {f"e{k + 1}_": (f"e{k}_", seeded(n))})
    out = split(out, lambda b: b.withColumn("before_", lag("e3_")), back=1)
    change = (F.try_divide(F.col("e3_"), F.col("before_")) - 1) * 100
    return out.withColumn("ta_trix", logistic(clip(change * 100, -700.0, 700.0))).drop("e0_", "e1_", "e2_", "e3_", "before_")
