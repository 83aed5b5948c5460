"""Trading statistics: returns, equity, drawdown, streaks, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")


def periods_per_year(timeframe: str) -> float:
    """Bars of a timeframe in a year: minutes (M), hours (H) or days (D); weeks are refused."""
    unit, n = timeframe[-1:].upper(), int(timeframe[:-1] or 1)
    minutes = {"M": 1, "T": 1, "H": 60, "D": 1440}.get(unit)
    if minutes is None:
        raise ValueError(f"unsupported timeframe {timeframe!r}")
    return 365 * 1440 / (minutes * n)


def trade_returns(trades: DataFrame) -> DataFrame:
    """Simple return of each trade in its direction."""
    return trades.withColumn("ret", F.try_divide(F.col("exit_price") - F.col("entry_price"), F.col("entry_price")) * F.col("direction"))


def _path(by: str, order: str):
    return Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def equity(returns: DataFrame, by: str = "symbol", order: str = "bar_id", ret: str = "ret") -> DataFrame:
    """Compounded returns, their running maximum and the fall from it.

    A return of -1 or less takes equity to zero or below, where it stays in the product;
    a null return changes nothing.
    """
    w = _path(by, order)
    grown = returns.withColumn("equity", F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))).over(w))
    return grown.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def max_drawdown(returns: DataFrame, by: str = "symbol", order: str = "bar_id", ret: str = "ret") -> DataFrame:
    """Deepest fall (first if several), where it is and where its peak was."""
    e = equity(returns, by, order, ret)
    low = e.groupBy(by).agg(F.min("drawdown").alias("max_drawdown"), F.min_by(order, F.struct("drawdown", order)).alias("trough"), F.min_by("peak", F.struct("drawdown", order)).alias("peak_equity"))
    top = e.join(low, by).where((F.col("equity") == F.col("peak_equity")) & (F.col(order) <= F.col("trough"))).groupBy(by).agg(F.min(order).alias("peak_at"))
    return low.join(top, by).select(by, "max_drawdown", "peak_at", "trough")


def sharpe(ret: Column, per_year: float, risk_free: float = 0.0) -> Column:
    """Annualised; null if returns do not vary."""
    s = F.stddev_samp(ret)
    return F.when(s > 0, (F.avg(ret) * per_year - risk_free) / (s * per_year**0.5))


def profit_factor(ret: Column) -> Column:
    """Gains over losses; infinite without losses, null without either."""
    up, down = F.sum(F.when(ret > 0, ret).otherwise(0.0)), F.abs(F.sum(F.when(ret < 0, ret).otherwise(0.0)))
    return F.when(down > 0, up / down).when(up > 0, F.lit(INF))


def basic(returns: DataFrame, per_year: float, by: str = "symbol", ret: str = "ret") -> DataFrame:
    x = F.col(ret)
    return returns.groupBy(by).agg(F.count(x).alias("n_trades"), (100 * F.avg((x > 0).cast("double"))).alias("win_rate"), profit_factor(x).alias("profit_factor"), sharpe(x, per_year).alias("sharpe"))


def detailed(returns: DataFrame, per_year: float, by: str = "symbol", ret: str = "ret") -> DataFrame:
    """Annualised mean and deviation, and mean and extreme wins and losses (0 if there are none)."""
    x = F.col(ret)
    win, loss = F.when(x > 0, x), F.when(x < 0, x)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return returns.groupBy(by).agg(
        (F.avg(x) * per_year).alias("annual_return"), (F.stddev_samp(x) * per_year**0.5).alias("annual_volatility"), zero(F.avg(win)).alias("avg_win"), zero(F.avg(loss)).alias("avg_loss"), zero(F.max(win)).alias("max_win"), zero(F.min(loss)).alias("max_loss")
    )


def streaks(returns: DataFrame, by: str = "symbol", order: str = "bar_id", ret: str = "ret") -> DataFrame:
    """Longest runs of wins and of losses."""
    w = Window.partitionBy(by).orderBy(order)
    signed = returns.select(by, order, F.signum(ret).cast("int").alias("s"))
    runs = signed.withColumn("new", (F.col("s") != F.coalesce(F.lag("s").over(w), F.lit(9))).cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = runs.groupBy(by, "run").agg(F.min("s").alias("s"), F.count("*").alias("n"))
    longest = lambda s: F.coalesce(F.max(F.when(F.col("s") == s, F.col("n"))), F.lit(0)).alias
    return each.groupBy(by).agg(longest(1)("max_wins"), longest(-1)("max_losses"))


def average_duration(trades: DataFrame, by: str = "symbol", start: str = "bar_id", end: str = "exit_bar") -> DataFrame:
    """Mean of the positive durations."""
    d = F.col(end) - F.col(start)
    return trades.groupBy(by).agg(F.avg(F.when(d > 0, d)).alias("avg_duration"))


def trade_stats(trades: DataFrame, by: str = "symbol") -> DataFrame:
    """Counts of labels and their ratios. ``win_loss_ratio`` is losses over profits."""
    n = lambda b: F.count_if(F.col("bin") == b)
    total = F.count("*")
    return trades.groupBy(by).agg(
        total.alias("n_trades"), n(1).alias("n_profit"), n(-1).alias("n_loss"), n(0).alias("n_time"), (n(1) / total).alias("profit_share"), (n(-1) / total).alias("loss_share"), (n(0) / total).alias("time_share"),
        F.when(n(1) > 0, n(-1) / n(1)).otherwise(F.lit(INF)).alias("win_loss_ratio"),
    )
