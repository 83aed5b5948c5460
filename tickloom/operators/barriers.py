"""Barriers around events and labels by which of them prices touch first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.asof import interval_join
from tickloom.operators.volatility import volatility


def prepared(bars: DataFrame, method: str = "bar_ewm", n: int = 20) -> DataFrame:
    """Bars with sigma and the last bar of their symbol, which the events found in them carry
    on: barriers then need no join."""
    from tickloom.functions.windows import whole

    return volatility(bars, method, n).withColumn("last_bar", whole(F.max, "bar_id"))


def horizontal(events: DataFrame, bars: DataFrame, method: str = "bar_ewm", n: int = 20, take: float = 2.0, stop: float = 2.0, min_return: float = 0.001) -> DataFrame:
    """Events with ``pt`` and ``sl``: entry times 1 +/- max(multiple of sigma, min_return).

    A missing sigma is filled from the next event of the symbol that has one. Events that
    carry sigma (see ``prepared``) keep theirs.
    """
    out = events
    if "sigma" not in events.columns:
        out = events.join(volatility(bars, method, n).select("symbol", "bar_id", "sigma"), ["symbol", "bar_id"], "left")
    later = Window.partitionBy("symbol").orderBy(F.desc("bar_id")).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("sigma", F.last("sigma", True).over(later))
    target = lambda m: F.when(F.col("sigma").isNotNull(), F.greatest(m * F.col("sigma"), F.lit(min_return)))
    out = out.withColumns({"up": target(take), "down": target(stop)})
    short = F.col("direction") == -1
    return out.withColumns({
        "pt": F.when(short, F.col("entry_price") * (1 - F.col("up"))).otherwise(F.col("entry_price") * (1 + F.col("up"))),
        "sl": F.when(short, F.col("entry_price") * (1 + F.col("down"))).otherwise(F.col("entry_price") * (1 - F.col("down"))),
    }).drop("up", "down")


def vertical(events: DataFrame, bars: DataFrame, hold: int = 60) -> DataFrame:
    """Events with ``t1``: the bar ``hold`` bars on, at most the last of the symbol."""
    out = events
    if "last_bar" not in events.columns:
        out = events.join(bars.groupBy("symbol").agg(F.max("bar_id").alias("last_bar")), "symbol")
    return out.withColumn("t1", F.least(F.col("bar_id") + hold, F.col("last_bar"))).drop("last_bar")


def fill_entry(events: DataFrame, bars: DataFrame, price: str = "close") -> DataFrame:
    """Missing entry prices from the event's bar."""
    own = bars.select("symbol", "bar_id", F.col(price).alias("bar_price"))
    return events.join(own, ["symbol", "bar_id"], "left").withColumn("entry_price", F.coalesce("entry_price", "bar_price")).drop("bar_price")


def _distinct(events: DataFrame) -> DataFrame:
    """Events with how often each occurs, so that grouping by their columns loses none."""
    return events.groupBy(*events.columns).agg(F.count("*").alias("_copies"))


def _repeated(trades: DataFrame) -> DataFrame:
    """Each row as often as its event occurs."""
    return trades.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop("_copy", "_copies")


def first_touch(events: DataFrame, bars: DataFrame, hold: int, use_high_low: bool = True) -> DataFrame:
    """Trades: bin (+1 profit, -1 loss, 0 time), exit_bar, exit_price, r_target.

    Bars from the entry to t1, both included; the upper barrier is tested first; exits
    on the entry bar are dropped; a missing barrier leaves only the time exit.
    ``hold``: bars that t1 is away at most (width of the join's buckets).
    """
    long = F.col("direction") == 1
    ev = _distinct(events).withColumns({"upper": F.when(long, F.col("pt")).otherwise(F.col("sl")), "lower": F.when(long, F.col("sl")).otherwise(F.col("pt"))})
    high, low = ("high", "low") if use_high_low else ("close", "close")
    own = bars.select("symbol", "bar_id", F.col(high).alias("top"), F.col(low).alias("bottom"), F.col("close").alias("last_close"))
    both = F.col("upper").isNotNull() & F.col("lower").isNotNull()
    touch = both & ((F.col("top") >= F.col("upper")) | (F.col("bottom") <= F.col("lower")))
    at_end = F.col("bar_bar_id") == F.col("t1")
    # one join meets the bars that touch and the one at t1
    met = interval_join(ev, own, "bar_id", "t1", max(1, hold), touch | at_end)
    hit = F.struct(F.col("bar_bar_id").alias("bar"), F.when(F.col("top") >= F.col("upper"), 1).otherwise(-1).alias("side"))
    out = met.groupBy(*ev.columns).agg(F.min(F.when(touch, hit)).alias("hit"), F.max(F.when(at_end, F.col("last_close"))).alias("end_close"))
    side = F.col("hit.side")
    out = out.withColumns({
        "bin": F.coalesce(side * F.col("direction"), F.lit(0)).cast("int"),
        "exit_bar": F.coalesce("hit.bar", "t1"),
        "exit_price": F.when(side == 1, F.col("upper")).when(side == -1, F.col("lower")).otherwise(F.col("end_close")),
    })
    out = out.withColumn("r_target", F.try_divide(F.col("exit_price") - F.col("entry_price"), F.col("entry_price")) * F.col("direction"))
    return _repeated(out.where(F.col("exit_bar") != F.col("bar_id")).drop("hit", "end_close", "upper", "lower"))


def trailing(events: DataFrame, bars: DataFrame, hold: int, share: float = 0.02) -> DataFrame:
    """Long trades under a stop that trails the highest close by ``share``: exit_bar,
    exit_price (close there) and the path of the stop; null exits where it never touches."""
    own = bars.select("symbol", "bar_id", "close")
    events = _distinct(events)
    met = interval_join(events, own, "bar_id", "t1", max(1, hold))
    path = Window.partitionBy(*events.columns).orderBy("bar_bar_id")
    met = met.withColumn("stop", F.max("close").over(path.rowsBetween(Window.unboundedPreceding, 0)) * (1 - share))
    touch = F.when(F.col("close") <= F.col("stop"), F.struct(F.col("bar_bar_id").alias("bar"), F.col("close").alias("price")))
    out = met.groupBy(*events.columns).agg(F.min(touch).alias("hit"), F.sort_array(F.collect_list(F.struct(F.col("bar_bar_id").alias("bar_id"), "stop"))).alias("stop_path"))
    return _repeated(out.withColumns({"exit_bar": F.col("hit.bar"), "exit_price": F.col("hit.price")}).drop("hit"))


def legacy(events: DataFrame, bars: DataFrame, hold: int, use_high_low: bool = False) -> DataFrame:
    """Labels without direction: pt above, sl below; both on one bar count as pt."""
    own = bars.select("symbol", "bar_id", F.col("high" if use_high_low else "close").alias("top"), F.col("low" if use_high_low else "close").alias("bottom"), "close")
    events = _distinct(events)
    met = interval_join(events, own, "bar_id", "t1", max(1, hold))
    touch = F.when(F.col("top") >= F.col("pt"), F.struct(F.col("bar_bar_id").alias("bar"), F.lit(1).alias("bin"), F.col("pt").alias("price"))).when(F.col("bottom") <= F.col("sl"), F.struct(F.col("bar_bar_id").alias("bar"), F.lit(-1).alias("bin"), F.col("sl").alias("price")))
    out = met.groupBy(*events.columns).agg(F.min(touch).alias("hit"), F.max_by("close", "bar_bar_id").alias("end_close"))
    return _repeated(out.withColumns({"bin": F.coalesce("hit.bin", F.lit(0)), "exit_bar": F.coalesce("hit.bar", "t1"), "exit_price": F.coalesce("hit.price", "end_close")}).drop("hit", "end_close"))


def sr_trades(bars: DataFrame, span: int = 5, hold: int = 20, method: str = "std", n: int = 20) -> DataFrame:
    """Support and resistance breaks, barriers from volatility, labels by first touch."""
    from tickloom.operators.events import level_break

    events = vertical(horizontal(level_break(prepared(bars, method, n), span), bars, method, n), bars, hold)
    return first_touch(events, bars, hold)
