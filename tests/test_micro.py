"""Hand-made cases of the rules that are easy to get wrong."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import kernels, scans
from tickloom.operators import barriers, indicators, ml, performance, regime, weights
from tickloom.operators.tickbars import tick_bars
from tickloom.sources import bars as src


def make(spark, rows, cols="symbol string, bar_id long, open double, high double, low double, close double, volume double"):
    return spark.createDataFrame(rows, cols).withColumn("open_time", F.expr("timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, cast(bar_id as int))"))


def flat(spark, highs, lows=None):
    lows = lows or [h - 1 for h in highs]
    return make(spark, [("a", i + 1, h, h, low, h, 1.0) for i, (h, low) in enumerate(zip(highs, lows))])


def test_plateau_gives_adjacent_pivots(spark):
    out = indicators.support_resistance(flat(spark, [1.0, 2.0, 5.0, 5.0, 2.0, 1.0]), 1).orderBy("bar_id").collect()
    assert [r["pivot_high"] for r in out] == [False, False, True, True, False, False]


def test_touching_a_level_is_no_break(spark):
    highs = [1.0, 5.0, 1.0, 5.0 + 1e-9, 1.0, 5.0 + 1e-7, 9.0]
    out = indicators.support_resistance(flat(spark, highs), 1).orderBy("bar_id").collect()
    assert out[2]["resistance"] == 5.0
    assert out[5]["resistance"] is None or out[5]["resistance"] != 5.0


def events(spark, rows):
    return spark.createDataFrame(rows, "symbol string, bar_id long, direction int, entry_price double, pt double, sl double, t1 long")


def test_upper_barrier_wins_and_entry_bar_drops(spark):
    b = make(spark, [("a", 1, 10.0, 10.0, 10.0, 10.0, 1.0), ("a", 2, 10.0, 13.0, 7.0, 10.0, 1.0), ("a", 3, 10.0, 10.0, 10.0, 11.0, 1.0)])
    out = barriers.first_touch(events(spark, [("a", 1, 1, 10.0, 12.0, 8.0, 3), ("a", 2, 1, 10.0, 12.0, 8.0, 3)]), b, 5).collect()
    assert len(out) == 1
    assert (out[0]["bin"], out[0]["exit_bar"], out[0]["exit_price"]) == (1, 2, 12.0)


def test_missing_barrier_leaves_time_exit(spark):
    b = make(spark, [("a", i, 10.0, 99.0, 1.0, 10.0 + i, 1.0) for i in (1, 2, 3)])
    out = barriers.first_touch(events(spark, [("a", 1, 1, 10.0, None, None, 3)]), b, 5).collect()
    assert (out[0]["bin"], out[0]["exit_bar"], out[0]["exit_price"]) == (0, 3, 13.0)


def test_cusum_tests_the_fall_first():
    assert kernels.cusum(np.array([0.0, 5.0, 2.0, -4.0]), np.full(4, 4.0))[0].tolist() == [0, 1, 0, -1]
    assert kernels.cusum(np.array([0.0, 50.0]), np.array([np.nan, np.nan]))[0].tolist() == [0, 0]


def test_tick_bars_reach_their_threshold(spark):
    rows = [("a", i, 1.0 + i, float(q), i % 2 == 0) for i, q in enumerate([3, 3, 4, 1, 9, 2])]
    ticks = spark.createDataFrame(rows, "symbol string, event_id long, price double, qty double, is_buyer_maker boolean").withColumn("ts", F.expr("timestamp_ntz'2020-01-01' + make_interval(0,0,0,0,0,0,event_id)"))
    out = tick_bars(ticks, "volume", 10.0).orderBy("candle_id").collect()
    assert [r["volume"] for r in out] == [10.0, 10.0, 2.0]
    assert [r["n_ticks"] for r in out] == [3, 2, 1]


def test_equal_count_bins(spark):
    rows = spark.createDataFrame([(1, i, -1.0 if i < 4 else 1.0) for i in range(7)], "g int, i int, ret double")
    out = regime.stability(rows, ["g"], ["i"], bins=3, least=2).first()
    assert out["n"] == 7 and 0 < out["stability"] < 1


def test_profit_factor_without_losses(spark):
    rows = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 0.0)], "symbol string, ret double")
    out = {r["symbol"]: r["profit_factor"] for r in performance.basic(rows, 365).collect()}
    assert out["a"] == float("inf") and out["b"] is None


def test_purged_folds(spark):
    rows = spark.createDataFrame([("a", i) for i in range(10)], "symbol string, bar_id long")
    got = ml.purged_folds(rows, 3, 0.1).where("role = 'train'").groupBy("fold").agg(F.sort_array(F.collect_list("bar_id")).alias("x")).collect()
    assert {r["fold"]: r["x"] for r in got} == {0: [4, 5, 6, 7, 8, 9], 1: [0, 1, 7, 8, 9], 2: [0, 1, 2, 3, 4]}


def test_return_weights_sum_to_events(spark):
    b = make(spark, [("a", i, 1.0, 1.0, 1.0, 10.0 + (i * 7) % 5, 1.0) for i in range(1, 20)])
    e = spark.createDataFrame([("a", 2, 6), ("a", 4, 9), ("a", 10, 12)], "symbol string, bar_id long, t1 long")
    out = weights.event_weights(e, b).collect()
    assert sum(r["w_return"] for r in out) == pytest.approx(3.0)
    assert max(r["w_time"] for r in out) == pytest.approx(1.0)


def test_ewm_std_matches_pandas(spark):
    b = make(spark, [("a", i, 1.0, 1.0, 1.0, float((i * 13) % 7), 1.0) for i in range(1, 12)])
    got = [r["s"] for r in scans.ewm_std(b, "close", "s", 5).orderBy("bar_id").collect()]
    want = pd.Series([float((i * 13) % 7) for i in range(1, 12)]).ewm(span=5, adjust=False).std()
    assert got[0] is None and np.allclose(got[1:], want[1:])


def test_regime_tree_separates(spark):
    rows = spark.createDataFrame([(i, float(i % 10), 0.02 + 0.001 * (i % 3) if i % 10 < 5 else -0.02 - 0.001 * (i % 3)) for i in range(200)], "i int, x double, ret double")
    tree = regime.fit_tree(rows, ["x"], ["i"], max_depth=1)
    assert tree.split and tree.split[0] == "x" and tree.split[1] < 5
    assert regime.feature_importances(tree) == {"x": 1.0}
    assert regime.leaf_report(rows, tree).count() == 2


def test_files_round_trip(spark, tmp_path):
    text = "Date,Open,High,LOW,Close,Volume\n2020-01-02,1,2,0.5,1.5,10\n2020-01-01,1,2,0.5,1.2,11\n"
    (tmp_path / "abc.csv").write_text(text)
    got = src.read_ohlcv(spark, str(tmp_path / "abc.csv"), "csv").orderBy("bar_id").collect()
    assert [(r["symbol"], r["bar_id"], r["close"]) for r in got] == [("abc", 1, 1.2), ("abc", 2, 1.5)]
    late = src.read_ohlcv(spark, str(tmp_path / "abc.csv"), "csv", start="2020-01-02").collect()
    assert len(late) == 1


def test_klines(spark):
    page = '[[0,"1","2","0.5","1.5","10",1,"15",3,"1","1","0"],[60000,"1","2","0.5","1.5","10",1,"15",4,"1","1","0"]]'
    got = src.parse_klines(spark.createDataFrame([("a", "1m", page), ("a", "1m", page)], "symbol string, timeframe string, page string"))
    assert got.count() == 2 and {r["number_of_trades"] for r in got.collect()} == {3, 4}


def test_timeframes():
    assert src.timeframe_minutes("4h") == 240
    with pytest.raises(ValueError):
        src.timeframe_minutes("x")
    with pytest.raises(ValueError):
        performance.periods_per_year("1W")
    assert src.estimate_download_seconds(10, 10, "1m", 5) == 14 * 10 * 0.5 / 5
