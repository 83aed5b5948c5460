"""Streams whose rows change a state: CUSUM events and bars of ticks, as the batch operators give them.

Rows wait in the state of their symbol until the watermark has passed them and are then taken in order
of time, so that what arrives out of order within the allowed lateness gives the results of a batch.
State and timers are in Spark's state store, so a query that starts again goes on where it was. The
session needs a store with several states a key (``spark.sql.streaming.stateStore.providerClass``:
RocksDBStateStoreProvider). Rows after the last watermark wait for more of the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.functions.kernels import cusum, flow_bars, volume_bars

#: Makes result rows from ordered rows and the state before them, and the state after them.
Step = Callable[[pd.DataFrame, tuple], "tuple[pd.DataFrame, tuple]"]


class InOrder(StatefulProcessor):
    """Keeps rows (``at_us`` in microseconds, ``tie_no`` and values) until they are due, then takes a step."""

    def __init__(self, columns: list[str], step: Step, start: tuple[float, ...]) -> None:
        self.columns, self.step, self.start = columns, step, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(["at_us long", "tie_no long", *[f"{c} double" for c in self.columns]]))
        self.state = handle.getValueState("state", ", ".join(f"s{k} double" for k in range(len(self.start))))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            if len(batch):
                held = batch[["at_us", "tie_no", *self.columns]]
                self.waiting.appendList([(int(r[0]), int(r[1]), *map(float, r[2:])) for r in held.itertuples(index=False, name=None)])
                low = int(held["at_us"].min())
                first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in held if r[0] <= passed]
        if not due:
            return
        rest = held[len(due) :]
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        before = tuple(self.state.get()) if self.state.exists() else self.start
        made, after = self.step(pd.DataFrame(due, columns=["at_us", "tie_no", *self.columns]), before)
        self.state.update(tuple(float(v) for v in after))
        if len(made):
            made.insert(0, "symbol", key[0])
            yield made

    def close(self) -> None:
        pass


def _run(rows: DataFrame, values: dict[str, Column], tie: str, step: Step, start: tuple[float, ...], schema: str, late: str) -> DataFrame:
    seen = rows.withWatermark("ts", late).select("symbol", "ts", F.unix_micros("ts").alias("at_us"), F.col(tie).cast("long").alias("tie_no"), *[v.cast("double").alias(c) for c, v in values.items()])
    return seen.groupBy("symbol").transformWithStateInPandas(InOrder(list(values), step, start), f"symbol string, {schema}", "Append", "EventTime")


def stream_cusum(prices: DataFrame, threshold: float, late: str = "10 minutes", column: str = "price", tie: str = "event_id") -> DataFrame:
    """Events of a symmetric CUSUM filter over a stream (symbol, ts, a tie, a price): symbol, ts, tie, direction (1 or -1)."""

    def step(g: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
        way, after = cusum(g["x"].to_numpy(float), np.full(len(g), threshold), state)
        hit = way != 0
        return pd.DataFrame({"at_us": g["at_us"][hit], "tie_no": g["tie_no"][hit], "direction": way[hit]}), after

    out = _run(prices, {"x": F.col(column)}, tie, step, (0.0, 0.0, float("nan")), "at_us long, tie_no long, direction long", late)
    return out.select("symbol", F.timestamp_micros("at_us").alias("ts"), F.col("tie_no").alias(tie), "direction")


_BAR = ("open", "high", "low", "close", "buy", "sell", "n", "first", "last")


def stream_tick_bars(ticks: DataFrame, method: str, threshold: float, side: str = "either", carry_over: bool = False, by_value: bool = False, late: str = "10 minutes") -> DataFrame:
    """Bars that close by volume or net flow (see ``tickbars.tick_bars``), each once it has closed.

    Columns: symbol, candle_id, open, high, low, close, buy_volume, sell_volume, n_ticks, open_time,
    close_time, direction. The state is what the running bar holds, and its number.
    """
    label = {"volume": volume_bars, "netflow": flow_bars}[method]
    size = F.col("price") * F.col("qty") if by_value else F.col("qty")
    values = {"price": F.col("price"), "buy": F.when(~F.col("is_buyer_maker"), size).otherwise(0.0), "sell": F.when(F.col("is_buyer_maker"), size).otherwise(0.0)}

    def step(g: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
        number, running = int(state[2]), state[3:]
        way, flow = label(g["buy"].to_numpy(float), g["sell"].to_numpy(float), threshold, side, carry_over, tuple(state[:2]))
        closes = (way != 0).astype(np.int64)
        p = g["price"]
        rows = pd.DataFrame({"open": p, "high": p, "low": p, "close": p, "buy": g["buy"], "sell": g["sell"], "n": 1.0, "first": g["at_us"].astype(float), "last": g["at_us"].astype(float), "way": way, "candle": number + np.cumsum(closes) - closes})
        if running[_BAR.index("n")]:
            rows = pd.concat([pd.DataFrame([(*running, 0, number)], columns=rows.columns), rows], ignore_index=True)
        bars = rows.groupby("candle", sort=True).agg(open=("open", "first"), high=("high", "max"), low=("low", "min"), close=("close", "last"), buy=("buy", "sum"), sell=("sell", "sum"), n=("n", "sum"), first=("first", "first"), last=("last", "last"), way=("way", "sum")).reset_index()
        done = bars[bars["way"] != 0]
        left = bars[bars["way"] == 0]
        kept = tuple(left.iloc[0][list(_BAR)]) if len(left) else (0.0,) * len(_BAR)
        made = done.assign(n=done["n"].astype("int64"), first=done["first"].astype("int64"), last=done["last"].astype("int64"))
        return made[["candle", *_BAR, "way"]], (*flow, number + int(closes.sum()), *kept)

    schema = "candle long, open double, high double, low double, close double, buy double, sell double, n long, first long, last long, way long"
    out = _run(ticks, values, "event_id", step, (0.0, 0.0, 0.0, *(0.0,) * len(_BAR)), schema, late)
    return out.select("symbol", F.col("candle").alias("candle_id"), "open", "high", "low", "close", F.col("buy").alias("buy_volume"), F.col("sell").alias("sell_volume"), F.col("n").alias("n_ticks"), F.timestamp_micros("first").alias("open_time"), F.timestamp_micros("last").alias("close_time"), F.col("way").alias("direction"))
