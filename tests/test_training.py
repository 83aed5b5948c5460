"""Training, importances, regime rules, files, filters and extension points on small tables."""

import json
import math
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import pieces
from tickloom.operators import extend, filters, levels, ml, mlperf, performance, regime, training, weights
from tickloom.sources import bars as src
from tickloom.sources import files


def small(features):
    return ml.forest(features, trees=5, depth=4)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    made = [(f"s{i % 2}", i, float(a), float(b), 1 if a > 0 else -1) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(made, "sample_id string, bar_id long, a double, b double, bin int").cache()


def test_trainers(rows):
    models = training.train_ensemble(rows, ["a", "b"], ["s0", "s1"], "voting", fit=small)
    assert sorted(models) == ["s0", "s1"]
    voted = training.predict_voting(models, rows)
    single = training.predict_single(models, rows)
    agree = voted.join(single.select("bar_id", F.col("predicted").alias("own")), "bar_id")
    assert agree.where("predicted <> own").count() == 0 and agree.count() == 300
    assert voted.where("predicted = bin").count() > 270
    bag = training.train_ensemble(rows, ["a", "b"], ["s0", "s1"], "bagging", n_models=3, fit=small)
    mean = training.predict_voting(bag, rows).select("bar_id", "predicted").collect()
    each = [{r.bar_id: float(r.predicted) for r in ml.predict(m, rows).collect()} for m in bag.values()]
    assert all(abs(r.predicted - np.mean([e[r.bar_id] for e in each])) < 1e-12 for r in mean)
    assert training.train_universal(rows, ["a", "b"], ["s0"], small) is not None
    with pytest.raises(ValueError):
        training.predict_single({"s0": models["s0"]}, rows)
    with pytest.raises(ValueError):
        training.train_ensemble(rows, ["a"], ["s0"], "stacking")


def test_importances(rows):
    table = training.feature_importance(rows, ["a", "b"], methods=training.METHODS, folds=2, key=("sample_id", "bar_id"), fit=small)
    got = {(r.feature, r.method): r.importance for r in table.collect()}
    assert len(got) == 8
    for m in training.METHODS:
        assert got["a", m] > got["b", m] + 0.2
    assert training.top_features(table, 1).first()["feature"] == "a"
    assert training.keep_columns(rows, training.important(table, 0.3), ["bar_id"]).columns == ["bar_id", "a"]


def test_permuted(rows):
    got = training.permuted(rows, "a", ["sample_id", "bar_id"], block=50)
    both = rows.select("bar_id", F.col("a").alias("was"), F.col("b").alias("b0")).join(got, "bar_id").toPandas()
    assert sorted(both.was) == sorted(both.a) and (both.b == both.b0).all() and (both.a != both.was).mean() > 0.8


@pytest.mark.parametrize("method", ["qr", "svd"])
def test_orthogonal(rows, method):
    mixed = rows.withColumn("b", F.col("a") * 2 + F.col("b"))
    made = training.orthogonal(mixed, ["a", "b"], method).transform(mixed).select("orth_0", "orth_1").toPandas().to_numpy()
    assert np.allclose(made.T @ made, np.eye(2), atol=1e-6)
    x = mixed.select("a", "b").toPandas()
    z = ((x - x.mean()) / x.std()).to_numpy()
    want = np.linalg.qr(z)[0] if method == "qr" else np.linalg.svd(z, full_matrices=False)[0]
    assert np.allclose(np.abs(made.T @ want), np.eye(2), atol=1e-5)


def test_prediction_trades(spark):
    made = spark.createDataFrame([("s", 1, 0.5, 10.0, 11.0), ("s", 2, -0.5, 10.0, 11.0), ("s", 3, 0.0, 10.0, 11.0), ("s", 4, None, 10.0, 11.0), ("s", 5, 0.9, 0.0, 11.0)], "sample_id string, bar_id long, predicted double, entry_price double, exit_price double")
    got = {r.entry_time: (r.direction, r.ret) for r in mlperf.prediction_trades(made).collect()}
    assert got == {1: (1, pytest.approx(0.1)), 2: (-1, pytest.approx(-0.1)), 5: (1, None)}
    with pytest.raises(ValueError):
        mlperf.best_model(spark.createDataFrame([("a", 1.0)], "model_name string, x double"), "y")


def test_equity_below_zero(spark):
    made = spark.createDataFrame([("s", 1, 0.1), ("s", 2, -1.2), ("s", 3, 0.1), ("s", 4, None)], "symbol string, bar_id long, ret double")
    got = [r.equity for r in performance.equity(made).orderBy("bar_id").collect()]
    assert got == pytest.approx([1.1, -0.22, -0.242, -0.242])
    assert performance.max_drawdown(made).first()["max_drawdown"] == pytest.approx(-1.22)


def test_even_bins(spark):
    rng = np.random.default_rng(1)
    made = spark.createDataFrame([(int(i % 3 == 0), int(rng.integers(0, 40)), int(i)) for i in range(500)] + [(7, 1, 1000), (7, 1, 1001)], "g int, at int, id int")
    from pyspark.sql import Window

    got = regime.even_bins(made, ["g"], ["at", "id"], 5).withColumn("want", F.ntile(5).over(Window.partitionBy("g").orderBy("at", "id")))
    assert got.where("bin <> want").count() == 0 and got.count() == 502


def test_categorical_split(spark):
    rng = np.random.default_rng(2)
    made = [(i, str("abcd"[i % 4]), float(i % 7), float(rng.normal() + (1.5 if i % 4 in (1, 3) else -1.0))) for i in range(400)]
    table = spark.createDataFrame(made, "id int, kind string, x double, ret double").cache()
    tree = regime.fit_tree(table, ["kind", "x"], ["id"], max_depth=1, categories=["kind"])
    assert tree.split[0] == "kind" and set(tree.split[1]) in ({"b", "d"}, {"a", "c"}, {"b"}, {"d"})
    report = regime.leaf_report(table, tree, order=["id"]).collect()
    assert [r.leaf_score for r in report] == sorted((r.leaf_score for r in report), reverse=True)
    rules = [json.loads(r.json) for r in regime.rules_json(regime.leaf_report(table, tree, order=["id"]), tree).collect()]
    assert all(json.loads(x["rule_clauses"])[0]["feature"] == "kind" for x in rules)
    assert regime.rules_text(regime.leaf_report(table, tree, order=["id"])).count() == 2
    assert regime.split_counts(tree) == {"kind": 1} and regime.feature_importances(tree) == {"kind": 1.0}
    assert regime.fit_tree(table, ["kind", "x"], ["id"], max_depth=1, categories=["kind"], delta_min=1e9).split is None
    own = regime.best_split(table, ["x"], ["id"], metric=lambda x: F.avg(x))
    assert own is None or own[0][0] == "x"


def test_files(spark, tmp_path):
    times = {"a": "2024-01-02", "b": "02-01-2024", "c": "2024-01-02 05:00:00"}
    (tmp_path / "1d").mkdir()
    for name, t in times.items():
        (tmp_path / "1d" / f"{name}.csv").write_text(f"Date,Open,HIGH,low,Close,Vol\n{t},1,2,0.5,1.5,10\n")
    got = {r.symbol: str(r.open_time) for r in files.read_folder(spark, str(tmp_path), "1d", ["a", "b", "c", "gone"], "csv").collect()}
    assert got == {"a": "2024-01-02 00:00:00", "b": "2024-01-02 00:00:00", "c": "2024-01-02 05:00:00"}
    both = files.read_timeframes(spark, str(tmp_path), ["1d", "9h"], file_format="csv")
    assert both.count() == 3 and both.first()["timeframe"] == "1d"
    (tmp_path / "1d" / "bad.csv").write_text("Date,Open,High,Low,Close\nsoon,1,2,0,1\n")
    with pytest.raises(Exception, match="not a time"):
        src.read_ohlcv(spark, str(tmp_path / "1d" / "bad.csv"), "csv").collect()
    with pytest.raises(ValueError):
        files.read_folder(spark, str(tmp_path), "9h")
    table = spark.createDataFrame([(1, "x"), (2, None)], "n int, s string")
    for suffix in ("csv", "json", "parquet"):
        path = str(tmp_path / f"out.{suffix}")
        files.save_table(table, path)
        assert {(r.n, r.s) for r in files.load_table(spark, path).collect()} == {(1, "x"), (2, None)}
    with pytest.raises(ValueError):
        files.save_table(table, str(tmp_path / "out.xlsx"))


def test_fetch(spark):
    jobs = spark.createDataFrame([("A", "1h", 0, 7_200_000), ("B", "1h", 0, 1)], "symbol string, timeframe string, start_ms long, end_ms long")

    def fetch(symbol, timeframe, start, end):
        if symbol == "B":
            raise OSError("down")
        for t in range(start, end, 3_600_000):
            yield json.dumps([[t, "1", "2", "0.5", "1.5", "9", t + 1, "3", 4, "0", "0", "0"]])

    assert files.fetch_history(jobs, fetch).count() == 2
    assert [r.error for r in files.failed_jobs(jobs, fetch).collect()] == ["OSError: down"]


def test_filters(spark):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=203))
    for n in (1, 2, 4, 8):
        h = filters.daubechies(n)
        assert len(h) == 2 * n and h.sum() == pytest.approx(math.sqrt(2)) and (h @ h) == pytest.approx(1)
        assert all(abs(h[2 * k :] @ h[: len(h) - 2 * k]) < 1e-8 for k in range(1, n))
        assert np.allclose(filters.wavelet_join(filters.wavelet_steps(x, h, 3), h, len(x)), x, atol=1e-6)
    assert np.allclose(sum(filters.modes(x, 5)), x)
    t = np.arange(400)
    slow, fast = np.sin(2 * math.pi * t / 200), np.sin(2 * math.pi * t / 8)
    bars = spark.createDataFrame(pd.DataFrame({"symbol": "s", "bar_id": t, "close": slow + fast}))
    for kind, cutoff, want in (("low", 0.05, slow), ("high", 0.05, fast), ("band", (0.15, 0.4), fast), ("stop", (0.15, 0.4), slow)):
        got = filters.butterworth(bars, cutoff=cutoff, kind=kind).orderBy("bar_id").toPandas()["butter"].to_numpy()
        assert np.abs(got - want)[60:-60].max() < 0.1, kind
    with pytest.raises(ValueError):
        filters.butter(3, 0.1, "notch")
    sg = filters.savitzky_golay(bars.withColumn("close", F.pow(F.col("bar_id"), F.lit(2.0)))).orderBy("bar_id").toPandas()
    assert np.allclose(sg.savgol, t.astype(float) ** 2)


def test_filters_in_pieces(spark):
    rng = np.random.default_rng(8)
    n = 1203
    frame = pd.concat([pd.DataFrame({"symbol": c, "bar_id": np.arange(1, k + 1), "close": 50 + np.cumsum(rng.normal(size=k))}) for c, k in (("a", n), ("b", 1), ("c", 2), ("d", 401))])
    bars = spark.createDataFrame(frame)
    forms = {
        "trend": lambda rows: filters.hodrick_prescott(bars, lamb=10.0, rows=rows),
        "butter": lambda rows: filters.butterworth(bars, cutoff=0.3, rows=rows),
        "wavelet": lambda rows: filters.wavelet(bars, family=2, mode="hard", rows=rows),
        "wavelet_part": lambda rows: filters.wavelet_levels(bars, [0, 2], rows=rows),
    }
    for name, form in forms.items():
        whole, cut = (form(rows).orderBy("symbol", "bar_id").toPandas() for rows in (None, 64))
        assert cut[["symbol", "bar_id", "close"]].equals(whole[["symbol", "bar_id", "close"]]), name
        assert np.allclose(cut[name], whole[name], rtol=0, atol=1e-9, equal_nan=True), name
    one = frame[frame.symbol == "a"].close.to_numpy()
    got = filters.wavelet(bars, family=2, rows=64).where("symbol = 'a'").orderBy("bar_id").toPandas().wavelet
    assert np.allclose(got, filters.wavelet_denoise(one, 2))
    # the Hodrick-Prescott trend solves its equations
    k = np.diff(np.eye(n), 2, axis=0)
    t = forms["trend"](64).where("symbol = 'a'").orderBy("bar_id").toPandas().trend.to_numpy()
    assert np.allclose(t + 10.0 * (k.T @ (k @ t)), one)
    with pytest.raises(ValueError):
        filters.wavelet(bars, mode="half")


def test_impulse_responses():
    x = np.cumsum(np.random.default_rng(4).normal(size=300))
    for order, cutoff, kind in ((3, 0.1, "low"), (2, (0.2, 0.5), "band")):
        b, a = filters.butter(order, cutoff, kind)
        xs, ys = [x[0]] * len(b), [x[0] * b.sum() / a.sum()] * len(a)
        for v in x:
            xs.append(v)
            ys.append(b @ xs[: -len(b) - 1 : -1] - a[1:] @ ys[: -len(a) : -1])
        assert np.allclose(filters.iir(b, a, x, x[0]), ys[len(a) :])


def test_medians_of_groups(spark):
    rows = [("a", float(v)) for v in (3, 1, 2, 2)] + [("b", 5.0), ("b", None), ("c", None)]
    df = spark.createDataFrame(rows, "symbol string, v double")
    assert {r.symbol: r["median"] for r in pieces.medians(df, "v").collect()} == {"a": 2.0, "b": 5.0}


def test_bars_are_stored_by_series(spark, tmp_path):
    day = pd.Timestamp("2024-01-01").to_pydatetime()
    made = lambda symbol, frame, close: [(symbol, frame, day + timedelta(days=k), close + k) for k in range(4)]
    table = lambda rows: spark.createDataFrame(rows, "symbol string, timeframe string, open_time timestamp_ntz, close double")
    path = str(tmp_path / "bars")
    seen = lambda: {(r.symbol, r.timeframe): r.close for r in src.load_bars(spark, path).groupBy("symbol", "timeframe").agg(F.min("close").alias("close")).collect()}
    src.save_bars(table(made("007", "1d", 10.0)), path)
    # what is there stays, another series comes to it
    src.save_bars(table(made("007", "1d", 50.0) + made("42", "4d", 20.0)), path)
    assert seen() == {("007", "1d"): 10.0, ("42", "4d"): 20.0}
    src.save_bars(table(made("42", "4d", 70.0)), path, overwrite=True)
    assert seen() == {("007", "1d"): 10.0, ("42", "4d"): 70.0}
    src.save_bars(table([]), path)
    src.save_bars(table([]), path, overwrite=True)
    assert len(seen()) == 2 and src.load_bars(spark, path, "007", "4d").count() == 0
    part = files.load_history(spark, path, "42", "4d", "2024-01-02", "2024-01-03").orderBy("open_time").collect()
    assert [(r.bar_id, r.close) for r in part] == [(1, 71.0), (2, 72.0)]
    sizes = src.stored_size(spark, path).collect()
    assert {r.folder.rsplit("/bars/")[1] for r in sizes} == {"timeframe=1d/symbol=007", "timeframe=4d/symbol=42"} and all(r.n_bytes > 0 and r.n_files >= 1 for r in sizes)


def test_nested_results(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([("a", {"x": 1.5}, [1, 2])], "name string, scores map<string, double>, folds array<int>")
    files.save_nested(rows, path)
    assert [json.loads(r.value) for r in spark.read.text(path).collect()] == [{"name": "a", "scores": {"x": 1.5}, "folds": [1, 2]}]


def test_pivot_kernels():
    x = np.array([1.0, 3, 2, 3, 5, 4, 5])
    brute = [next((k for k in range(i) if x[i - 1 - k] >= x[i]), i) for i in range(len(x))]
    assert levels._unbeaten(x).tolist() == brute


def test_weights_repeats(spark):
    bars = spark.createDataFrame([("s", i, 10.0 + i) for i in range(1, 9)], "symbol string, bar_id long, close double")
    events = spark.createDataFrame([("s", 2, 4), ("s", 2, 4), ("s", 3, 6), ("s", 5, None), ("s", 7, 6)], "symbol string, bar_id long, t1 long")
    got = sorted((r.bar_id, round(r.uniqueness, 9)) for r in weights.uniqueness(events, bars).collect())
    assert got == [(2, round((1 / 2 + 1 / 3 + 1 / 3) / 3, 9))] * 2 + [(3, round((1 / 3 + 1 / 3 + 1 + 1) / 4, 9)), (5, 0.0), (7, 0.0)]


def test_extension_points(spark):
    rng = np.random.default_rng(5)
    close = 100 + np.cumsum(rng.normal(size=120))
    frame = pd.DataFrame({"symbol": "s", "bar_id": np.arange(1, 121), "open_time": pd.date_range("2024-01-01", periods=120), "open": close, "high": close + 1, "low": close - 1, "close": close, "volume": 1.0})
    bars = spark.createDataFrame(frame).withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))
    got = extend.rolling_apply(bars, "close", "spread", 5, lambda v: float(v.max() - v.min())).orderBy("bar_id").toPandas()
    want = frame.close.rolling(5).max() - frame.close.rolling(5).min()
    assert np.allclose(got.spread[4:], want[4:]) and got.spread[:4].isna().all()
    mine = lambda b: b.where("bar_id % 10 = 5").select("symbol", "bar_id", "open_time", F.lit(1).alias("direction"), F.col("close").alias("entry_price"))
    barrier = lambda e, b: e.withColumns({"pt": F.col("entry_price") + 2, "sl": F.col("entry_price") - 2})
    trades = extend.Strategy(mine, barrier=barrier, hold=10).generate_trades(bars).collect()
    for r in trades:
        path = frame[(frame.bar_id >= r.bar_id) & (frame.bar_id <= r.t1)]
        hit = path[(path.high >= r.pt) | (path.low <= r.sl)]
        assert r.exit_bar == (hit.bar_id.iloc[0] if len(hit) else r.t1)
    assert extend.Strategy(mine).generate_events(bars).columns[:3] == ["symbol", "bar_id", "open_time"]
    assert extend.shift_info("1d", "1h")["periods_per_higher"] == 24
    metric = extend.metric(lambda v: float(v.median()))
    assert bars.groupBy("symbol").agg(metric(F.col("close")).alias("m")).first()["m"] == pytest.approx(np.median(close))


def test_a_model_comes_back_with_its_features(spark, tmp_path):
    rows = spark.createDataFrame([(float(i % 7), float(i % 3), i % 2) for i in range(60)] + [(None, 1.0, 1)], "x double, y double, bin int")
    model = ml.forest(["x", "y"], trees=3, depth=3).fit(rows)
    ml.save(model, str(tmp_path / "kept"), kind="forest")
    again, state = ml.load(str(tmp_path / "kept"))
    assert state == {"features": ["x", "y"], "target": "bin", "about": {"kind": "forest"}}
    got, want = (sorted((r.x or -1.0, r.y, r.bin, r.predicted or "", r.confidence or 0.0) for r in ml.predict(m, rows).collect()) for m in (again, model))
    assert got == want and len(got) == 61
    assert [r for r in ml.predict(model, rows).collect() if r.x is None][0].predicted is None


def test_every_symbol_has_its_share_of_each_part(spark):
    rows = spark.createDataFrame([(f"{s}{i}", s) for s in "abc" for i in range(10) for _ in range(2)], "sample_id string, symbol string")
    parts = ml.split_samples(rows, "symbol").withColumn("symbol", F.substring("sample_id", 1, 1))
    assert {(r["symbol"], r["split"]): r["count"] for r in parts.groupBy("symbol", "split").count().collect()} == {(s, p): n for s in "abc" for p, n in (("train", 6), ("val", 2), ("test", 2))}
    assert ml.split_samples(rows.limit(0), "symbol").collect() == []
