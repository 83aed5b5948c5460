"""Sample weights of labelled events: overlap, uniqueness, returns, time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.pieces import running


def _cum(order: str = "bar_id"):
    return Window.partitionBy("symbol").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def co_events(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars with ``n_events``: how many intervals [bar_id, t1] cover them (a sweep of +1 and -1)."""
    good = events.where("t1 IS NOT NULL AND t1 >= bar_id")
    steps = good.select("symbol", "bar_id", F.lit(1).alias("step")).union(good.select("symbol", F.col("t1") + 1, F.lit(-1)))
    steps = steps.groupBy("symbol", "bar_id").agg(F.sum("step").alias("step"))
    out = bars.select("symbol", "bar_id", "close").join(steps, ["symbol", "bar_id"], "left")
    return out.withColumn("n_events", F.sum(F.coalesce("step", F.lit(0))).over(_cum())).drop("step")


def co_events_on_grid(events: DataFrame, step_s: int, start: str = "open_time", end: str = "end_time") -> DataFrame:
    """How many intervals [start, end] cover each point of a symbol's time grid: symbol, at, n_events.

    The grid runs from the first start to the last end in steps of ``step_s`` seconds. Intervals
    without a start or an end, or that end before they start, count nowhere; one that lies between two
    points covers none. The running sum goes over pieces of the grid.
    """
    good = events.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start)))
    span = good.groupBy("symbol").agg(F.min(start).alias("lo"), F.max(end).alias("hi"))
    steps = lambda t: F.timestamp_diff("MICROSECOND", F.col("lo"), F.col(t)) / (step_s * 1_000_000)
    placed = good.join(span, "symbol").select("symbol", F.ceil(steps(start)).alias("first"), F.floor(steps(end)).alias("last")).where("first <= last")
    marks = placed.select("symbol", F.col("first").alias("slot"), F.lit(1).alias("step")).union(placed.select("symbol", F.col("last") + 1, F.lit(-1)))
    marks = marks.groupBy("symbol", "slot").agg(F.sum("step").alias("step"))
    grid = span.select("symbol", "lo", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(steps("hi")))).alias("slot"))
    met = grid.join(marks, ["symbol", "slot"], "left").withColumn("step", F.coalesce("step", F.lit(0)))
    out = running(met, {"n_events": ("sum", "step")}, number="slot")
    return out.select("symbol", F.timestamp_add("SECOND", F.col("slot") * step_s, F.col("lo")).alias("at"), "n_events")


def _covered(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Events with ``inverse`` and ``shared``: over their bars, the sums of 1/(number of
    events) and of absolute log returns over the number of events.

    Bars, starts and ends of events go through the windows of one shuffle by symbol; both
    ends of an event then meet in one aggregation. No product of events and bars.
    """
    w = Window.partitionBy("symbol").orderBy("bar_id")
    move = F.abs(F.log("close") - F.log(F.lag("close").over(w)))
    kept = F.struct(*events.columns)
    none, step = F.lit(None).cast(events.schema.simpleString()), lambda n: F.lit(n).cast("int")
    good = F.col("t1").isNotNull() & (F.col("t1") >= F.col("bar_id"))
    # place: what comes first at a bar - its own row, then what looks the sums up after it
    bar = bars.select("symbol", F.col("bar_id").alias("at"), step(0).alias("place"), step(0).alias("step"), move.alias("move"), none.alias("event"), step(0).alias("sign"))
    marks = F.array(
        F.struct(F.col("bar_id").alias("at"), step(-1).alias("place"), F.when(good, 1).otherwise(0).alias("step"), none.alias("event"), step(0).alias("sign")),
        F.struct((F.col("t1") + 1).alias("at"), step(-1).alias("place"), F.when(good, -1).otherwise(0).alias("step"), none.alias("event"), step(0).alias("sign")),
        F.struct((F.col("bar_id") - 1).alias("at"), step(1).alias("place"), step(0).alias("step"), kept.alias("event"), step(-1).alias("sign")),
        F.struct(F.coalesce(F.col("t1"), F.col("bar_id") - 1).alias("at"), step(1).alias("place"), step(0).alias("step"), kept.alias("event"), step(1).alias("sign")),
    )
    ends = events.select("symbol", F.explode(marks).alias("m")).select("symbol", "m.at", "m.place", "m.step", F.lit(None).cast("double").alias("move"), "m.event", "m.sign").where("at IS NOT NULL")
    order = Window.partitionBy("symbol").orderBy("at", "place").rowsBetween(Window.unboundedPreceding, 0)
    run = bar.union(ends).withColumn("n", F.sum("step").over(order))
    is_bar = (F.col("place") == 0)
    run = run.withColumns({"inverse": F.when(is_bar, 1 / F.greatest("n", F.lit(1))), "shared": F.when(is_bar & (F.col("n") > 0), F.col("move") / F.col("n"))})
    run = run.withColumns({c: F.coalesce(F.sum(c).over(order), F.lit(0.0)) for c in ("inverse", "shared")})
    copies = F.count("*") / 2  # rows that repeat meet in one group, and go apart again
    met = run.where("event IS NOT NULL").groupBy("event").agg(copies.cast("int").alias("copies"), *[(F.sum(F.col(c) * F.col("sign")) / copies).alias(c) for c in ("inverse", "shared")])
    return met.select("event.*", "inverse", "shared", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_copy")).drop("_copy")


def uniqueness(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Events with ``uniqueness``: the mean of 1/(number of events) over their bars; 0 without any."""
    return _with_uniqueness(_covered(events, bars)).drop("inverse", "shared")


def _with_uniqueness(covered: DataFrame) -> DataFrame:
    length = F.col("t1") - F.col("bar_id") + 1
    return covered.withColumn("uniqueness", F.when(length > 0, F.col("inverse") / length).otherwise(0.0))


def return_weights(events: DataFrame, bars: DataFrame, normalize: bool = True) -> DataFrame:
    """Events with ``w_return``: absolute log returns over their bars, shared among the
    events of each bar; scaled so that the weights of a symbol sum to its events."""
    return _with_returns(_covered(events, bars), normalize).drop("inverse", "shared")


def _with_returns(covered: DataFrame, normalize: bool) -> DataFrame:
    out = covered.withColumn("w_return", F.when(F.col("t1") >= F.col("bar_id"), F.col("shared")).otherwise(0.0))
    if not normalize:
        return out
    own = Window.partitionBy("symbol")
    return out.withColumn("w_return", F.when(F.sum("w_return").over(own) > 0, F.col("w_return") * F.count("*").over(own) / F.sum("w_return").over(own)).otherwise(F.col("w_return")))


def time_decay(events: DataFrame, last: float = 0.5) -> DataFrame:
    """Events (with uniqueness) with ``w_time``: linear in cumulated uniqueness, 1 at the
    newest; ``last`` at the oldest end, a negative one zeroes the oldest part."""
    own = Window.partitionBy("symbol")
    c, total = F.sum("uniqueness").over(_cum()), F.sum("uniqueness").over(own)
    out = events.withColumns({"c": c, "total": total})
    slope = F.when(F.lit(last) >= 0, (1 - last) / F.col("total")).otherwise(1 / ((last + 1) * F.col("total")))
    w = F.greatest(1 - slope * F.col("total") + slope * F.col("c"), F.lit(0.0))
    return out.withColumn("w_time", F.when(F.col("total") > 0, w).otherwise(1.0)).drop("c", "total")


def event_weights(events: DataFrame, bars: DataFrame, last: float = 0.5) -> DataFrame:
    """All three weights and their product ``w_event``."""
    covered = _with_returns(_with_uniqueness(_covered(events, bars)), True).drop("inverse", "shared")
    return time_decay(covered, last).withColumn("w_event", F.col("uniqueness") * F.col("w_return") * F.col("w_time"))


def close_from_trades(trades: DataFrame) -> DataFrame:
    """A price series from entries and exits of trades: the later write of a bar wins, and
    gaps between known bars are filled in a line."""
    points = trades.select("symbol", "bar_id", F.col("entry_price").alias("price"), F.lit(0).alias("k")).union(trades.select("symbol", F.col("exit_bar"), F.col("exit_price"), F.lit(1)))
    known = points.where("price IS NOT NULL").groupBy("symbol", "bar_id").agg(F.max_by("price", F.struct("k", "price")).alias("price"))
    w = Window.partitionBy("symbol").orderBy("bar_id")
    spans = known.withColumns({"next_bar": F.coalesce(F.lead("bar_id").over(w) - 1, F.col("bar_id")), "next_price": F.lead("price").over(w)})
    each = spans.withColumn("at", F.explode(F.sequence("bar_id", "next_bar")))
    line = F.col("price") + (F.col("next_price") - F.col("price")) * (F.col("at") - F.col("bar_id")) / (F.col("next_bar") + 1 - F.col("bar_id"))
    return each.select("symbol", F.col("at").alias("bar_id"), F.coalesce(line, F.col("price")).alias("close"))
