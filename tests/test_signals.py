"""Filters against direct statements of their definitions, and streams against batches."""

import numpy as np
import pytest

from tickloom.operators import filters as flt
from tickloom.streaming.bars import stream_bars


def test_hp_solves_its_system():
    x = np.array([float((i * 17) % 11) for i in range(25)])
    k = np.diff(np.eye(25), 2, axis=0)
    assert np.allclose(flt.hp_trend(x, 50.0), np.linalg.solve(np.eye(25) + 50.0 * k.T @ k, x))


def test_butterworth_halves_power_at_the_cutoff():
    b, a = flt.butter_low(3, 0.2)
    z = np.exp(-1j * np.pi * 0.2)
    h = np.polyval(b[::-1], z) / np.polyval(a[::-1], z)
    assert abs(h) == pytest.approx(2**-0.5, abs=1e-9)
    assert b.sum() / a.sum() == pytest.approx(1.0)


def test_savgol_keeps_parabolas():
    w = flt.savgol_weights(11, 2)
    assert sum(w) == pytest.approx(1.0) and sum(wi * k * k for wi, k in zip(w, range(-5, 6))) == pytest.approx(0.0, abs=1e-12)


def test_haar_keeps_constants():
    assert np.allclose(flt.haar_denoise(np.full(37, 5.0)), 5.0)


def test_sadf_matches_least_squares(spark):
    x = np.cumsum(np.random.default_rng(0).normal(size=45))
    df = spark.createDataFrame([("a", i + 1, float(v)) for i, v in enumerate(x)], "symbol string, bar_id long, close double")
    got = [r["sadf"] for r in flt.sadf(df).orderBy("bar_id").collect()]
    t, best = 44, -np.inf
    for s in range(t - 29):
        y, d = x[s:t], np.diff(x[s : t + 1])
        m = np.column_stack([np.ones(len(y)), y])
        beta, rss = np.linalg.lstsq(m, d, rcond=None)[:2]
        se = np.sqrt(rss[0] / (len(y) - 2) * np.linalg.inv(m.T @ m)[1, 1])
        best = max(best, beta[1] / se)
    assert got[29] is None and got[44] == pytest.approx(best, rel=1e-6)


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", i, float(i), 1.0) for i in range(20)]
    ticks = spark.createDataFrame(rows, "symbol string, event_id long, price double, qty double").selectExpr("*", "timestamp_seconds(event_id * 600) AS ts")
    ticks.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    query = stream_bars(stream).writeStream.format("memory").queryName("bars").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {tuple(r) for r in stream_bars(ticks).collect()}
    assert {tuple(r) for r in spark.table("bars").collect()} == want and len(want) == 4
