"""Stateful streams against the batch operators, with rows out of order and a query that starts again."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions.kernels import cusum
from tickloom.operators.tickbars import tick_bars
from tickloom.streaming.states import stream_cusum, stream_tick_bars

TICKS = "symbol string, sec long, event_id long, price double, qty double, is_buyer_maker boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def ticks_of(spark, rows):
    return spark.createDataFrame(rows, TICKS).withColumn("ts", F.timestamp_seconds("sec")).drop("sec")


@pytest.fixture
def stored(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(PROVIDER)


@pytest.fixture(scope="module")
def parts():
    """Ticks in three files; within 300 seconds rows are out of order, also across files. The last row only moves the watermark."""
    draw = random.Random(5)
    rows = [(s, 1000 + 20 * i, i * 2 + k, round(50 + draw.gauss(0, 2), 2), float(draw.randint(1, 9)), draw.random() < 0.5) for i in range(120) for k, s in enumerate("ab") if s == "a" or i % 3]
    rows += [("a", 1400, 9000, 51.0, 2.0, True), ("a", 1400, 9001, 47.0, 2.0, False)]
    mixed = sorted(rows, key=lambda r: r[1] + draw.uniform(0, 250))
    third = len(mixed) // 3
    return [mixed[:third], mixed[third : 2 * third], mixed[2 * third :], [("z", 9000, 1, 1.0, 1.0, True)]], rows


def streamed(spark, folder, parts, build, name):
    """Each part is a file that comes while the query is down: it starts again from its checkpoint each time."""
    source, out = f"{folder}/in-{name}", f"{folder}/out-{name}"
    schema = None
    for part in parts:
        df = ticks_of(spark, part)
        schema = df.schema
        df.coalesce(1).write.mode("append").parquet(source)
        query = build(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/state-{name}").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    return spark.read.parquet(out)


def test_cusum_stream_is_batch(spark, stored, parts, tmp_path):
    files, rows = parts
    got = streamed(spark, tmp_path, files, lambda t: stream_cusum(t, 3.0), "cusum")
    found = sorted((r["symbol"], r["event_id"], r["direction"]) for r in got.collect())
    want = []
    for s in "ab":
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2]))
        import numpy as np

        way, _ = cusum(np.array([r[3] for r in own]), np.full(len(own), 3.0))
        want += [(s, r[2], int(w)) for r, w in zip(own, way) if w]
    assert found == sorted(want) and len(found) > 10


@pytest.mark.parametrize("method,side,carry", [("volume", "either", False), ("netflow", "abs", True)])
def test_tick_bar_stream_is_batch(spark, stored, parts, tmp_path, method, side, carry):
    files, rows = parts
    got = streamed(spark, tmp_path, files, lambda t: stream_tick_bars(t, method, 20.0, side, carry), method)
    columns = ["symbol", "candle_id", "open", "high", "low", "close", "buy_volume", "sell_volume", "n_ticks", "direction", F.unix_micros("open_time").alias("t0"), F.unix_micros("close_time").alias("t1")]
    batch = tick_bars(ticks_of(spark, rows), method, 20.0, side, carry).where("direction <> 0")
    take = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    want = take(batch)
    assert take(got) == want and len(want) > 10
