"""Volatility estimators over bars: column ``sigma``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.pieces import split
from tickloom.functions.scans import ewm_mean, ewm_std
from tickloom.functions.windows import clip, lag, pct_change, rolling, values


def _with_quantiles(df: DataFrame, low: float, high: float) -> DataFrame:
    """Bars with two exact quantiles of their symbol's returns, lo and hi, aggregated once."""
    both = df.groupBy("symbol").agg(F.percentile("ret", F.array(F.lit(low), F.lit(high))).alias("_q"))
    return df.join(both, "symbol").withColumns({"lo": F.get("_q", F.lit(0)), "hi": F.get("_q", F.lit(1))}).drop("_q")


def _middle(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def _ln(a: str, b: str) -> Column:
    return F.log(F.col(a) / F.col(b))


def volatility(bars: DataFrame, method: str = "bar_ewm", n: int = 20, span: int = 50, low: float = 0.005, high: float = 0.995, absolute: bool = False, reference: str = "median", ref_span: int = 200) -> DataFrame:
    """Bars with ``sigma``. Methods: bar_ewm, bar_volnorm_ewm, std, ewm_std, mad, winsor_std,
    biweight, parkinson, garman_klass, rogers_satchell, yang_zhang.

    bar_* and winsor_std clip at quantiles of the whole series. bar_*: ``absolute`` smooths the sizes
    of returns in place of their squares; ``reference`` is the volume that counts as usual, the median
    of the series or an exponential mean (ewm) over ``ref_span`` bars.
    """
    out = split(bars, lambda b: b.withColumn("ret", pct_change("close")), back=1)
    if method in ("bar_ewm", "bar_volnorm_ewm"):
        out = out.withColumn("ret", F.coalesce("ret", F.lit(0.0)))
        if method == "bar_volnorm_ewm":
            if reference == "ewm":
                out = ewm_mean(out, {"ref": ("volume", 2 / (ref_span + 1))}).withColumn("ref", F.greatest("ref", F.lit(1e-12)))
            elif reference == "median":
                out = out.join(bars.groupBy("symbol").agg(F.greatest(F.median("volume"), F.lit(1e-12)).alias("ref")), "symbol")
            else:
                raise ValueError(f"unknown reference {reference!r}")
            out = out.withColumn("ret", F.col("ret") / F.sqrt(F.greatest(F.col("volume") / F.col("ref"), F.lit(1e-12)))).drop("ref")
        cut = clip(F.col("ret"), F.col("lo"), F.col("hi"))
        out = _with_quantiles(out, low, high).withColumn("sq", F.abs(cut) if absolute else F.pow(cut, F.lit(2.0)))
        return ewm_mean(out, {"sq_mean": ("sq", 2 / (span + 1))}).withColumn("sigma", F.sqrt("sq_mean")).drop("lo", "hi", "sq", "sq_mean")
    if method == "std":
        return out.withColumn("sigma", rolling(F.stddev_samp, "ret", n))
    if method == "ewm_std":
        return ewm_std(out, "ret", "sigma", n)
    if method == "mad":
        out = out.withColumn("dist", F.abs(F.col("ret") - rolling(_middle, "ret", n)))
        return out.withColumn("sigma", 1.4826 * rolling(_middle, "dist", n)).drop("dist")
    if method == "winsor_std":
        out = _with_quantiles(out, 0.01, 0.99).withColumn("cut", clip(F.col("ret"), F.col("lo"), F.col("hi")))
        return out.withColumn("sigma", rolling(F.stddev_samp, "cut", n)).drop("lo", "hi", "cut")
    if method == "biweight":
        out = out.withColumn("held", values("ret", n))
        out = out.withColumn("med", F.when(F.size("held") == n, _median("held", n)))
        out = out.withColumn("mad", F.when(F.col("med").isNotNull(), _median(F.transform("held", lambda x: F.abs(x - F.col("med"))), n)))
        total = lambda f: F.aggregate(F.transform("held", f), F.lit(0.0), lambda a, b: a + b)
        u2 = lambda x: F.pow((x - F.col("med")) / (9 * (1.4826 * F.col("mad") + 1e-12)), F.lit(2.0))
        weight = lambda x: F.when(u2(x) < 1, F.pow(1 - u2(x), F.lit(2.0))).otherwise(0.0)
        num = total(lambda x: F.pow(x - F.col("med"), F.lit(2.0)) * weight(x))
        den = F.greatest(total(weight) - 1e-12, F.lit(1e-12))
        return out.withColumn("sigma", F.when(F.col("mad").isNotNull(), F.sqrt(num / den))).drop("held", "med", "mad")
    hl, co = _ln("high", "low"), _ln("close", "open")
    if method == "parkinson":
        term = F.pow(hl, F.lit(2.0)) / (4 * math.log(2))
    elif method == "garman_klass":
        term = 0.5 * F.pow(hl, F.lit(2.0)) - (2 * math.log(2) - 1) * F.pow(co, F.lit(2.0))
    elif method == "rogers_satchell":
        term = _ln("high", "close") * _ln("high", "open") + _ln("low", "close") * _ln("low", "open")
    elif method == "yang_zhang":
        # as commonly written here: opens against opens, and the Garman-Klass term inside
        square = lambda x: F.pow(x, F.lit(2.0))
        out = out.withColumns({"oo": square(F.log(lag("open") / F.col("open"))), "oc": square(co), "gk": 0.5 * square(hl) - (2 * math.log(2) - 1) * square(co)})
        var = rolling(F.avg, "oo", n) + 0.34 * rolling(F.avg, "oc", n) + 0.66 * rolling(F.avg, "gk", n)
        return out.withColumn("sigma", F.sqrt(clip(var, 0.0))).drop("oo", "oc", "gk")
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.withColumn("term", term).withColumn("sigma", F.sqrt(clip(rolling(F.avg, "term", n), 0.0))).drop("term")


def _median(held: str | Column, n: int) -> Column:
    s = F.array_sort(held)
    return (F.get(s, F.lit((n - 1) // 2)) + F.get(s, F.lit(n // 2))) / 2
