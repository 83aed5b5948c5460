"""Extension points: indicators, events, strategies, barriers and metrics of a user's own.

An indicator or event generator is any function from bars to a DataFrame; managers
compose them into one plan, which Catalyst optimises as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType, pandas_udf

from tickloom.operators import asof, barriers, performance
from tickloom.sources.bars import timeframe_minutes

#: Bars in, bars with more columns out.
Indicator = Callable[[DataFrame], DataFrame]
#: Bars in, events (symbol, bar_id, open_time, direction, entry_price) out.
EventGenerator = Callable[[DataFrame], DataFrame]
#: Events and bars in, events with pt and sl out.
Barrier = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass
class IndicatorManager:
    """Indicators in the order they were added; each may read the columns of those before.

    ``independent``: each reads the bars alone, as when they run side by side, and new
    columns are joined by bar.
    """

    independent: bool = False
    indicators: list[Indicator] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)

    def add(self, indicator: Indicator) -> "IndicatorManager":
        self.indicators.append(indicator)
        return self

    def calculate(self, bars: DataFrame, append: bool = True) -> DataFrame:
        """Bars with the columns of all indicators, or only key and new columns."""
        out = bars
        for indicator in self.indicators:
            if self.independent:
                own = indicator(bars)
                new = [c for c in own.columns if c not in out.columns]
                out = out.join(own.select("symbol", "bar_id", *new), ["symbol", "bar_id"], "left")
            else:
                out = indicator(out)
        self.columns = [c for c in out.columns if c not in bars.columns]
        return out if append else out.select("symbol", "bar_id", *self.columns)


@dataclass
class HigherTimeframeManager(IndicatorManager):
    """Indicators of the bars themselves, then columns of coarser bars, each shifted by one of them."""

    higher: list[tuple[Indicator, list[str], str]] = field(default_factory=list)

    def add_higher(self, indicator: Indicator, columns: list[str], suffix: str) -> "HigherTimeframeManager":
        self.higher.append((indicator, columns, suffix))
        return self

    def calculate(self, bars: DataFrame, append: bool = True, coarse: DataFrame | None = None) -> DataFrame:
        """As above; without coarser bars their columns are left out. A symbol that has none gets nulls."""
        out = super().calculate(bars, True)
        for indicator, columns, suffix in self.higher if coarse is not None else []:
            w = Window.partitionBy("symbol").orderBy("bar_id")
            slow = indicator(coarse)
            for c in columns:
                name = f"{c}_{suffix}"
                right = slow.select("symbol", "open_time", F.lag(c).over(w).alias(name))
                out = asof.asof(out, right, "open_time", name)
        self.columns = [c for c in out.columns if c not in bars.columns]
        return out if append else out.select("symbol", "bar_id", *self.columns)


def shift_info(higher: str, lower: str, shifted: bool = True) -> dict[str, int]:
    """Coarser bars that values are shifted by, and how many finer bars one of those holds."""
    if not shifted:
        return {"shift_periods": 0, "lost_lower_periods": 0, "higher_minutes": 0, "lower_minutes": 0, "periods_per_higher": 0}
    a, b = timeframe_minutes(higher), timeframe_minutes(lower)
    return {"shift_periods": 1, "lost_lower_periods": a // b, "higher_minutes": a, "lower_minutes": b, "periods_per_higher": a // b}


@dataclass
class Strategy:
    """Indicators, events, barriers and labels as one pipeline."""

    events: EventGenerator
    indicators: list[Indicator] = field(default_factory=list)
    barrier: Barrier | None = None
    hold: int = 60
    use_high_low: bool = True

    def generate_events(self, bars: DataFrame, set_barriers: bool = True) -> DataFrame:
        for indicator in self.indicators:
            bars = indicator(bars)
        own = barriers.prepared(bars) if set_barriers and self.barrier is None else bars
        found = self.events(own)
        if not set_barriers:
            return found
        return barriers.vertical((self.barrier or barriers.horizontal)(found, bars), bars, self.hold)

    def generate_trades(self, bars: DataFrame, trailing: float | None = None) -> DataFrame:
        """Labels by first touch; with ``trailing`` exits under a stop that trails by that share."""
        found = self.generate_events(bars)
        return barriers.trailing(found, bars, self.hold, trailing) if trailing else barriers.first_touch(found, bars, self.hold, self.use_high_low)

    def analysis(self, bars: DataFrame) -> DataFrame:
        """Counts and shares of labels by symbol."""
        return performance.trade_stats(self.generate_trades(bars))


def metric(function: Callable[[pd.Series], float]) -> Callable[[Column], Column]:
    """A metric of regime trees from a function of returns: a grouped aggregate in Arrow batches."""
    wrapped = pandas_udf(function, "double", PandasUDFType.GROUPED_AGG)
    return lambda x: wrapped(x)


def rolling_apply(bars: DataFrame, column: str, output: str, n: int, function: Callable[[pd.Series], float]) -> DataFrame:
    """A function of the last n values of a symbol; null with fewer."""
    w = Window.partitionBy("symbol").orderBy("bar_id").rowsBetween(-(n - 1), 0)
    wrapped = pandas_udf(function, "double", PandasUDFType.GROUPED_AGG)
    return bars.withColumn(output, F.when(F.count(column).over(w) == n, wrapped(F.col(column)).over(w)))


def plot_frame(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Bars as charts need them: rising or not, and the direction and entry price of the event at
    each bar. An event at no bar's time belongs to the next bar; after the last bar it goes."""
    at = asof.asof(events.select("symbol", "open_time", "direction", "entry_price"), bars.select("symbol", "open_time", "bar_id"), "open_time", "bar_id", direction="forward")
    signal = at.where("bar_id IS NOT NULL AND direction <> 0").groupBy("symbol", "bar_id").agg(F.max_by("direction", "open_time").alias("signal"), F.max_by("entry_price", "open_time").alias("signal_price"))
    return bars.withColumn("rising", F.col("close") >= F.col("open")).join(signal, ["symbol", "bar_id"], "left")


def stop_frame(trades: DataFrame, bars: DataFrame, hold: int) -> DataFrame:
    """The bars between each event and its t1, with the trailing stop's path: what a chart of exits shows."""
    path = trades.select("symbol", "bar_id", F.explode("stop_path").alias("p")).select("symbol", F.col("bar_id").alias("event_bar"), F.col("p.bar_id").alias("bar_id"), "p.stop")
    return path.join(bars.select("symbol", "bar_id", "open", "high", "low", "close"), ["symbol", "bar_id"])
