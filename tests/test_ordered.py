"""Order statistics, density clusters and the bubble test over pieces, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.orders import rolling_order
from tickloom.operators import levels
from tickloom.operators.filters import sadf

SERIES = "symbol string, bar_id long, close double"


def series(seed, n, symbol="a", holes=0.0):
    draw = random.Random(seed)
    return [(symbol, i + 1, None if draw.random() < holes else round(draw.gauss(50, 4), 1)) for i in range(n)]


@pytest.mark.parametrize("n,rows", [(1, 7), (4, 7), (5, 7), (12, 5)])
def test_rolling_order(spark, n, rows):
    data = series(1, 60) + series(2, 40, "b", 0.05) + series(3, 3, "c") + [("d", 1, None)]
    got = rolling_order(spark.createDataFrame(data, SERIES), "close", n, {"mid": "median", "mad": "mad", "rank": "percent_rank", "low": 0.1}, rows)
    found = {(r["symbol"], r["bar_id"]): (r["mid"], r["mad"], r["rank"], r["low"]) for r in got.collect()}
    assert len(found) == len(data) == got.count()
    for s, i, x in data:
        held = [v for t, j, v in data if t == s and i - n < j <= i and v is not None]
        if len(held) < n:
            assert found[s, i] == (None,) * 4
            continue
        mid = np.median(held)
        want = (mid, np.median(np.abs(np.array(held) - mid)), sum(v < x for v in held) / n, np.quantile(held, 0.1))
        assert found[s, i] == pytest.approx(want)


def test_rolling_order_refuses(spark):
    df = spark.createDataFrame([], SERIES)
    assert rolling_order(df, "close", 3, {"m": "median"}).collect() == []
    for n, kind in ((0, "median"), (3, "mode"), (3, 1.5)):
        with pytest.raises(ValueError):
            rolling_order(df, "close", n, {"m": kind})


def clusters(prices, reach, least):
    """Labels by rising price, None for noise."""
    near = lambda a, b: abs(a / reach - b / reach) <= 1
    cores = sorted({p for p in prices if sum(near(p, q) for q in prices) >= least})
    label, last = {}, None
    for p in cores:
        label[p] = 0 if last is None else label[last] + (not near(p, last))
        last = p
    return {p: label[p] if p in label else min((label[c] for c in cores if near(p, c)), default=None) for p in prices}


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_density(spark, least):
    draw = random.Random(least)
    data = [(s, i, None if i % 19 == 5 else round(draw.uniform(90, 110), 1)) for s, n in (("a", 80), ("b", 1), ("c", 40)) for i in range(n)]
    data += [("a", 500 + i, 100.3) for i in range(30)] + [("z", 1, -1.0), ("z", 2, -1.0)]
    points = spark.createDataFrame(data, SERIES).withColumn("cluster", F.lit("theirs"))
    got = levels.density(points, ["symbol"], "close", 0.003, least, cells=4)
    assert got.columns == points.columns
    found = {(r["symbol"], r["bar_id"]): r["cluster"] for r in got.collect()}
    want = {}
    for s in "abc":
        own = [(i, p) for t, i, p in data if t == s and p is not None]
        label = clusters([p for _, p in own], 0.003 * np.mean([p for _, p in own]), least)
        want |= {(s, i): label[p] for i, p in own if label[p] is not None}
    assert found == want


def test_density_of_two_is_islands(spark):
    points = spark.createDataFrame(series(9, 60), SERIES).withColumn("open_time", F.col("bar_id"))
    group = lambda df: sorted(sorted(x) for x in (r[1] for r in df.groupBy("cluster").agg(F.collect_list("bar_id")).collect()))
    assert group(levels.density(points, ["symbol"], "close", 0.004, 2, 8)) == group(levels.islands(points, ["symbol"], "close", 0.004, 2))


@pytest.mark.parametrize("rows", [10, 64, 1024])
def test_sadf_in_tiles(spark, rows):
    data = [(s, i, None if p is None else p * 1.01**i) for s, i, p in series(4, 90) + series(5, 70, "b", 0.02) + series(6, 8, "c")]
    got = sadf(spark.createDataFrame(data, SERIES), "close", 12, rows)
    found = {(r["symbol"], r["bar_id"]): r["sadf"] for r in got.collect()}
    assert len(found) == len(data)
    for name in "abc":
        x = np.array([np.nan if p is None else p for s, _, p in data if s == name])
        for t in range(len(x)):
            stats = []
            for start in range(t - 12 + 1):
                y, d = x[start:t], np.diff(x[start : t + 1])
                if np.isnan(d).any():
                    continue
                design = np.column_stack([np.ones(len(y)), y])
                coef, *_ = np.linalg.lstsq(design, d, rcond=None)
                error = d - design @ coef
                stats.append(coef[1] / np.sqrt(error @ error / (len(d) - 2) / ((y - y.mean()) @ (y - y.mean()))))
            assert found[name, t + 1] == (pytest.approx(max(stats), rel=1e-6) if stats else None)
