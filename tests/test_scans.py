"""A symbol in several pieces against the same recurrences, windows and joins over whole symbols."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import kernels, pieces, scans
from tickloom.functions.windows import lag, rolling
from tickloom.operators import asof, barriers, events, filters, indicators, ta
from tickloom.operators.tickbars import tick_bars

BARS = "symbol string, bar_id long, open double, high double, low double, close double, volume double"


def prices(seed, n, symbol="a"):
    draw = random.Random(seed)
    rows, p = [], 50.0
    for i in range(n):
        p = round(max(5.0, p + draw.gauss(0, 1)), 2)
        rows.append((symbol, i + 1, p, p + draw.random(), p - draw.random(), p, float(draw.randint(1, 9))))
    return rows


@pytest.fixture(scope="module")
def bars(spark):
    rows = prices(1, 150) + prices(2, 3, "b") + prices(3, 64, "c")
    df = spark.createDataFrame(rows, BARS).withColumn("open_time", F.expr("timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, cast(bar_id as int))"))
    return df.repartition(5).cache()


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("symbol", "bar_id").collect()]


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        for x, y in zip(g, w):
            assert (x is None) == (y is None or y != y), (g, w)
            assert x is None or isinstance(x, str) or np.isclose(x, y, rtol=1e-9, atol=1e-9), (g, w)


@pytest.mark.parametrize("rows", [4, 17, 1000])
def test_exponential_means(spark, bars, rows):
    gappy = bars.withColumn("x", F.when(~((F.col("bar_id") < 6) | (F.col("bar_id") % 7 == 3) | F.col("bar_id").between(40, 60)), F.col("close")))
    got = scans.ewm_mean(gappy, {"m": ("x", 0.2), "n": ("close", 0.5)}, rows)
    got = scans.ewm_std(scans.ewm_std(got, "x", "s", 9, adjust=True, rows=rows), "close", "t", 5, rows=rows)
    frame = gappy.orderBy("symbol", "bar_id").toPandas()
    by = frame.groupby("symbol")
    want = pd.DataFrame({
        "m": by["x"].transform(lambda x: x.ewm(alpha=0.2, adjust=False).mean()), "n": by["close"].transform(lambda x: x.ewm(alpha=0.5, adjust=False).mean()),
        "s": by["x"].transform(lambda x: x.ewm(span=9, adjust=True).std()), "t": by["close"].transform(lambda x: x.ewm(span=5, adjust=False).std()),
    })
    same(values(got, "m", "n", "s", "t"), list(want.itertuples(index=False, name=None)))


def plain_wilder(x, n):
    out = np.full(len(x), np.nan)
    good = np.flatnonzero(~np.isnan(x))
    if len(good) >= n:
        at = good[0] + n - 1
        out[at] = x[good[0] : at + 1].mean()
        for i in range(at + 1, len(x)):
            out[i] = (out[i - 1] * (n - 1) + x[i]) / n
    return out


@pytest.mark.parametrize("rows", [5, 1000])
def test_wilder_starts_with_a_mean(bars, rows):
    late = bars.withColumn("x", F.when(F.col("bar_id") > 3, F.col("close")))
    got = scans.recur(late, {"w": ("x", scans.wilder(7)), "e": ("x", scans.seeded(6))}, rows)
    frame = late.orderBy("symbol", "bar_id").toPandas()
    want = np.concatenate([plain_wilder(g["x"].to_numpy(float), 7) for _, g in frame.groupby("symbol")])
    same([(r[0],) for r in values(got, "w")], [(w,) for w in want])
    e = np.array([np.nan if r[0] is None else r[0] for r in values(got, "e")])[:150]
    x = frame["x"].to_numpy(float)[:150]
    assert np.isnan(e[:8]).all() and np.isclose(e[8], x[3:9].mean()) and np.allclose(e[9:], e[8:-1] + 2 / 7 * (x[9:] - e[8:-1]))


@pytest.mark.parametrize("f,columns", [
    (ta.rsi, ["ta_rsi"]), (ta.macd, ["ta_macd", "ta_macd_signal", "ta_macd_hist"]), (ta.atr, ["ta_atr"]), (ta.adx, ["ta_adx", "ta_plus_di", "ta_minus_di"]), (lambda b: ta.trix(b, 5), ["ta_trix"]),
    (indicators.rsi, ["rsi"]), (indicators.macd, ["macd_line", "macd_signal"]), (indicators.atr, ["atr"]), (filters.kalman_filter, ["kalman"]),
])
def test_indicators_in_pieces(bars, monkeypatch, f, columns):
    whole = values(f(bars), *columns)
    for module in (pieces, scans):
        monkeypatch.setattr(module, "ROWS", 8)
    monkeypatch.setattr(pieces.split, "__defaults__", (0, 0, 8))
    assert sum(r[0] is not None for r in whole) > 20
    same(values(f(bars), *columns), whole)


def test_prefixes_of_maps():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 101):
        a, b = draw.uniform(0, 1, n), draw.normal(size=n)
        x, y = scans.prefixes(a, b)
        value, want = 3.0, []
        for p, q in zip(a, b):
            value = p * value + q
            want.append(value)
        assert np.allclose(x * 3.0 + y, want)


@pytest.mark.parametrize("threshold,rows", [(0.5, 7), (4.0, 20), (1e9, 40)])
def test_cusum_hands_over(bars, monkeypatch, threshold, rows):
    want = values(events.cusum_filter(bars, threshold), "symbol", "bar_id", "direction")
    monkeypatch.setattr(scans, "ROWS", rows)
    assert values(events.cusum_filter(bars, threshold), "symbol", "bar_id", "direction") == want
    assert (len(want) > 5) == (threshold < 1e9)


def test_cusum_by_deviation_in_pieces(bars, monkeypatch):
    want = values(events.cusum_filter(bars, multiplier=20.0, span=10), "symbol", "bar_id", "direction")
    monkeypatch.setattr(scans, "ROWS", 16)
    assert want and values(events.cusum_filter(bars, multiplier=20.0, span=10), "symbol", "bar_id", "direction") == want


def tick_rows(seed, n):
    draw = random.Random(seed)
    return [("a", i, 10.0 + draw.random(), float(draw.randint(0, 9)), draw.random() < 0.5) for i in range(n)]


@pytest.mark.parametrize("method,side,carry,threshold", [("volume", "either", False, 30.0), ("volume", "buy", True, 20.0), ("netflow", "abs", False, 15.0), ("netflow", "pos", True, 9.0), ("volume", "either", False, 1e9)])
def test_tick_bars_in_pieces(spark, method, side, carry, threshold):
    rows = tick_rows(4, 120)
    ticks = spark.createDataFrame(rows, "symbol string, event_id long, price double, qty double, is_buyer_maker boolean").withColumn("ts", F.expr("timestamp_ntz'2020-01-01' + make_interval(0,0,0,0,0,13 * cast(event_id div 2 as int))")).repartition(4)
    buy, sell = (np.array([r[3] if r[4] == maker else 0.0 for r in rows]) for maker in (False, True))
    way, _ = (kernels.volume_bars if method == "volume" else kernels.flow_bars)(buy, sell, threshold, side, carry)
    number = np.concatenate([[0], np.cumsum(way != 0)[:-1]])
    want = [(int(k), int((number == k).sum()), float((buy + sell)[number == k].sum()), int(way[number == k].sum())) for k in np.unique(number)]
    for size in (40 if carry or threshold > 100 else 9, 1000):
        got = tick_bars(ticks, method, threshold, side, carry, rows=size).orderBy("candle_id")
        assert [(r.candle_id, r.n_ticks, r.volume, r.direction) for r in got.collect()] == want


@pytest.mark.parametrize("method,side,threshold", [("netflow", "abs", 1e9), ("volume", "either", 1e9)])
def test_few_rounds_for_many_pieces(spark, monkeypatch, method, side, threshold):
    """A state that no piece forgets passes 50 pieces in rounds of the order of their square root."""
    rows = tick_rows(6, 99)
    ticks = spark.createDataFrame(rows, "symbol string, event_id long, price double, qty double, is_buyer_maker boolean").withColumn("ts", F.expr("timestamp_ntz'2020-01-01' + make_interval(0,0,0,0,0,13 * cast(event_id as int))"))
    rounds, write = [], scans.written
    monkeypatch.setattr(scans, "written", lambda df, tag: (rounds.append(tag), write(df, tag))[1])
    got = tick_bars(ticks, method, threshold, side, rows=2).collect()
    assert [(r.candle_id, r.n_ticks, r.volume) for r in got] == [(0, len(rows), sum(r[3] for r in rows))]
    assert rounds.count("states") <= 12


@pytest.mark.parametrize("side", ["either", "buy"])
def test_volume_bars_out_of_phase_take_one_round(spark, monkeypatch, side):
    """Equal ticks: bars that begin at different ticks never close at the same one."""
    rows = [("a", i, 10.0, 1.0, False) for i in range(99)] + [("b", i, 10.0, 0.25 * (i % 5), i % 3 == 0) for i in range(60)]
    ticks = spark.createDataFrame(rows, "symbol string, event_id long, price double, qty double, is_buyer_maker boolean").withColumn("ts", F.expr("timestamp_ntz'2020-01-01' + make_interval(0,0,0,0,0,13 * cast(event_id as int))"))
    rounds, write = [], scans.written
    monkeypatch.setattr(scans, "written", lambda df, tag: (rounds.append(tag), write(df, tag))[1])
    got = tick_bars(ticks, "volume", 7.0, side, rows=2)
    assert rounds.count("states") <= 3
    bars = lambda b: sorted((r.symbol, r.candle_id, r.n_ticks, r.volume, r.direction) for r in b.collect())
    assert bars(got) == bars(tick_bars(ticks, "volume", 7.0, side))


@pytest.mark.parametrize("side", ["either", "buy", "sell"])
def test_steps_of_volume_bars(side):
    """The step function of some rows, made in parts, gives what the kernel leaves for any state before them."""
    draw = np.random.default_rng(1)
    for limit in (10.0, 50.0, 300.0, 5000.0):
        size, maker = np.round(draw.exponential(20, 150), 2), draw.random(150) < 0.5
        buy, sell = np.where(maker, 0.0, size), np.where(maker, size, 0.0)
        own = kernels.VolumeMap(limit, side)
        for part in (slice(0, 40), slice(40, 41), slice(41, 150)):
            own.add(buy[part], sell[part])
        for x in np.append(draw.random(30), 0.0) * limit:
            state = (x / 4, 3 * x / 4) if side == "either" else (x, x)
            assert own.leaves(state, *own.steps()) == pytest.approx(kernels.volume_bars(buy, sell, limit, side, False, state)[1])


def test_windows_in_pieces(bars):
    f = lambda b: b.withColumns({"mean": rolling(F.avg, "close", 6), "before": lag("close"), "next": F.lead("close", 2).over(windows_by())})
    from tickloom.functions.windows import by_bar as windows_by

    assert values(pieces.split(bars, f, back=5, ahead=2, rows=4), "bar_id", "mean", "before", "next") == values(f(bars), "bar_id", "mean", "before", "next")


def test_running_values_in_pieces(bars):
    some = bars.withColumn("x", F.when((F.col("bar_id") > 5) & (F.col("bar_id") % 9 < 3), F.col("volume")))
    kinds = {k: (k, "x") for k in ("sum", "max", "min", "last")}
    names = ["symbol", "bar_id", *kinds]
    assert values(pieces.running(some, kinds, rows=6), *names) == values(pieces.running(some, kinds), *names)


def test_numbers_by_buckets(bars):
    got = pieces.numbered(bars.drop("bar_id"), ("open_time",), F.date_trunc("week", "open_time"))
    assert values(got, "symbol", "bar_id", "close") == values(bars, "symbol", "bar_id", "close")


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_in_buckets(spark, bars, direction):
    draw = random.Random(5)
    rows = [(s, draw.randint(0, 170), None if draw.random() < 0.2 else float(k)) for s in ("a", "c", "d") for k in range(12)]
    rows = list({(s, t): (s, t, v) for s, t, v in rows}.values())
    right = spark.createDataFrame(rows, "symbol string, at long, v double")
    left = bars.select("symbol", F.col("bar_id").alias("at"), F.col("bar_id"))
    for bucket in (None, lambda t: F.floor(t / 9)):
        got = {(r.symbol, r.at): r.v for r in asof.asof(left, right, "at", "v", direction=direction, bucket=bucket).collect()}
        for s, t in got:
            seen = [(u, v) for q, u, v in rows if q == s and v is not None and (u <= t if direction == "backward" else u >= t)]
            assert got[s, t] == ((max(seen) if direction == "backward" else min(seen))[1] if seen else None)


def test_repeated_events_stay(spark, bars):
    e = spark.createDataFrame([("a", 2, 1, 50.0, 90.0, 5.0, 20)] * 2 + [("a", 5, -1, 50.0, None, 52.0, 30)] * 3 + [("b", 1, 1, 50.0, 99.0, 1.0, 3)], "symbol string, bar_id long, direction int, entry_price double, pt double, sl double, t1 long")
    for f in (barriers.first_touch, barriers.trailing, barriers.legacy):
        got = f(e, bars, 30)
        counts = {(r["symbol"], r["bar_id"]): r["count"] for r in got.groupBy("symbol", "bar_id").count().collect()}
        assert counts == {("a", 2): 2, ("a", 5): 3, ("b", 1): 1}
        assert "_copies" not in got.columns


def test_events_on_a_time_grid(spark):
    from tickloom.operators import weights

    rows = [("a", 0, 25), ("a", 3, 9), ("a", 10, 20), ("a", 20, 5), ("a", None, 9), ("b", 7, 7)]
    at = lambda c: f"timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, 0, 0, 0, {c})"
    ev = spark.createDataFrame(rows, "symbol string, s int, e int").selectExpr("symbol", f"{at('s')} AS open_time", f"{at('e')} AS end_time")
    got = [(r.symbol, r.at.second, r.n_events) for r in weights.co_events_on_grid(ev, 10).orderBy("symbol", "at").collect()]
    assert got == [("a", 0, 1), ("a", 10, 2), ("a", 20, 2), ("b", 7, 1)]
    assert weights.co_events_on_grid(ev.limit(0), 10).collect() == []
