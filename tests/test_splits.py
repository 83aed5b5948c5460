"""Split search, exact quantiles, folds and triangular factors over many tasks, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import pieces
from tickloom.operators import ml, regime, training

ROWS = "bar_id long, symbol string, ret double, a double, kind string"


@pytest.fixture(scope="module")
def data():
    draw = random.Random(11)
    return [(i // 2, "xy"[i % 2], round(draw.gauss(0.1, 1), 3), None if i % 17 == 3 else round(draw.random(), 2), draw.choice(["p", "q", None])) for i in range(240)]


def scored(rows, bins=5, least=3):
    """Metric (Sharpe) times stability of one side, its rows in order."""
    ret = np.array([r[2] for r in sorted(rows, key=lambda r: (r[0], r[1]))])
    parts = np.array_split(ret, bins)
    size = np.array([len(p) for p in parts], float)
    share = np.array([(p < 0).mean() if len(p) else 0.0 for p in parts])
    f = (size * share).sum() / size.sum()
    v = max((size * share**2).sum() / size.sum() - f * f, 0)
    even = math.exp(-v / (f * (1 - f) + 1e-9)) * (0.5 + (size >= least).sum()) / (bins + 1)
    return ret.mean() / ((ret.std(ddof=1) if len(ret) > 1 else 0.0) + 1e-12) * even


@pytest.mark.parametrize("n", [240, 31])
def test_score_splits(spark, data, n):
    data = data[:n]
    candidates = [("a", 0.25), ("a", 0.5), ("kind", ("p",)), ("kind", ("p", "q")), ("a", -1.0)]
    got = regime.score_splits(spark.createDataFrame(data, ROWS), candidates, ["bar_id", "symbol"])
    found = {(r["cand"], r["left"]): (r["n"], r["score"]) for r in got.collect()}
    want = {}
    for i, (column, at) in enumerate(candidates):
        for left in (True, False):
            own = [r for r in data if left == ((r[4] in at) if column == "kind" else r[3] is not None and r[3] <= at)]
            if own:
                want[i, left] = (len(own), scored(own))
    assert found.keys() == want.keys()
    for k, (size, score) in want.items():
        assert found[k] == (size, pytest.approx(score, abs=1e-9))


def test_quantiles(spark, data):
    levels = [0.0, 0.05, 0.31, 0.5, 0.95, 1.0]
    df = spark.createDataFrame([*data, (900, "z", float("nan"), float("nan"), None)], ROWS)
    x = [r[3] for r in data if r[3] is not None]
    assert pieces.quantiles(df, "a", levels) == pytest.approx(list(np.quantile(x, levels)))
    assert pieces.quantiles(df.where("a = 0.5 OR a IS NULL").limit(0), "a", levels) == []
    assert pieces.quantiles(df.withColumn("a", F.lit(2.0)), "a", levels) == [2.0] * 6


@pytest.mark.parametrize("kind", ["long", "timestamp", "string"])
def test_ranges_follow_the_order(spark, data, kind):
    if kind == "string":
        with pytest.raises(Exception):
            pieces.ranges(spark.createDataFrame(data, ROWS), "symbol").alias("x")
        return
    df = spark.createDataFrame(data, ROWS).withColumn("at", F.col("bar_id") if kind == "long" else F.timestamp_seconds("bar_id"))
    got = pieces.numbered(df, ("at", "symbol"), pieces.ranges(df, "at", 8), "no", (), 0).orderBy("no").collect()
    assert [(r["no"], r["bar_id"], r["symbol"]) for r in got] == [(i, d[0], d[1]) for i, d in enumerate(sorted(data))]
    assert pieces.numbered(df.limit(0), ("at",), pieces.ranges(df.limit(0), "at"), "no", (), 0).collect() == []


def test_folds_of_all_rows(spark, data):
    roles = ml.purged_folds(spark.createDataFrame(data, ROWS).withColumn("all", F.lit(0)), 4, 0.05, "all", "bar_id", ["symbol"]).collect()
    place = {(r[0], r[1]): i for i, r in enumerate(sorted(data))}
    n, gap = len(data), int(len(data) * 0.05)
    assert len(roles) == 4 * n
    for r in roles:
        i, start, stop = place[r["bar_id"], r["symbol"]], r["fold"] * (n // 4), (r["fold"] + 1) * (n // 4)
        assert r["role"] == ("test" if start <= i < stop else "train" if i < start - gap or i >= stop + gap else None)


def test_nearly_dependent_columns_stay_orthogonal(spark):
    draw = random.Random(3)
    rows = spark.createDataFrame([(x := draw.gauss(0, 1), x + 1e-7 * draw.gauss(0, 1), draw.gauss(5, 2)) for _ in range(500)], "a double, b double, c double").repartition(7)
    made = training.orthogonal(rows, ["a", "b", "c"]).transform(rows).toPandas().to_numpy()
    # a product matrix holds a condition of 1e14 here; the factor one of 1e7
    assert np.allclose(made.T @ made, np.eye(3), atol=1e-7)


def test_factors_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(training, "FACTORS", 2)
    draw = np.random.default_rng(1)
    x = draw.normal(size=(40, 3))
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double").repartition(9)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    found = training.orthogonal(df, ["a", "b", "c"])
    want, r = np.linalg.qr(z)
    assert np.allclose(z @ found.basis, want * np.sign(np.diag(r)), atol=1e-10)
    constant = df.withColumn("c", F.lit(1.0))
    for method in ("qr", "svd"):
        made = training.orthogonal(constant, ["a", "b", "c"], method)
        two = z[:, :2] @ made.basis[:2]
        assert np.isfinite(made.basis).all() and np.allclose(np.linalg.svd(two)[1][:2], 1, atol=1e-8)
