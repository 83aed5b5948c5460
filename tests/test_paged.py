"""Pages as partitions and as offsets of a stream."""

import json
import os
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tickloom.sources import paged

HOUR = 3_600_000


def made():
    """A function that tasks get by value, since they can't import this module."""
    hour = HOUR

    def klines(symbol, timeframe, start_ms, end_ms):
        hours = range(-(-start_ms // hour), -(-end_ms // hour))
        if hours:
            yield json.dumps([[h * hour, "1", "3", "0.5", str(h), "7", h * hour + hour - 1, "9", 2] for h in hours])

    return klines


klines = made()


@pytest.mark.parametrize("start,end,width", [(0, 10, 3), (1, 10, 3), (2, 4, 3), (3, 3, 3), (5, 4, 3), (0, 3, 100)])
def test_pages_cover_once(start, end, width):
    got = [p.job[2:] for p in paged.cut("a", "1h", start, end, width)]
    assert [x for a, b in got for x in range(a, b)] == list(range(start, end))
    assert all(0 < b - a <= width for a, b in got)


def test_bars_of_pages(spark):
    jobs = [("a", "1h", 0, 50 * HOUR), ("b", "1h", 5 * HOUR, 9 * HOUR), ("c", "1h", 0, 0)]
    got = paged.read_pages(spark, klines, jobs, 7 * HOUR)
    found = sorted((r["symbol"], r["close"]) for r in got.collect())
    assert found == sorted((s, float(h)) for s, _, a, b in jobs for h in range(a // HOUR, b // HOUR))
    assert paged.read_pages(spark, klines, []).collect() == []


def test_stream_goes_on_where_it_was(spark, tmp_path):
    clock = tmp_path / "clock"

    def newest():
        return int(clock.read_text())

    for now in (5, 5, 12, 30):
        clock.write_text(str(now * HOUR))
        query = paged.stream_pages(spark, klines, newest, [("a", "1h", 2 * HOUR, None), ("b", "1h", 0, 8 * HOUR)], 4 * HOUR).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        query.processAllAvailable()
        query.stop()
    rows = spark.read.parquet(f"{tmp_path}/out").select("symbol", F.explode(F.from_json("page", "array<array<string>>")).alias("k")).select("symbol", F.col("k")[4].cast("int").alias("h")).collect()
    assert sorted((r["symbol"], r["h"]) for r in rows) == sorted([("a", h) for h in range(2, 30)] + [("b", h) for h in range(8)])


def test_lost_tasks_ask_for_their_page_only(tmp_path):
    script = textwrap.dedent(f"""
        import os, uuid
        from pyspark.sql import SparkSession
        from tickloom.sources import paged
        from tests.test_paged import HOUR, klines

        def fetch(symbol, timeframe, start, end):
            asked = len([f for f in os.listdir({str(tmp_path)!r}) if f.startswith(f"{{start}}-")])
            open(f"{tmp_path}/{{start}}-{{uuid.uuid4()}}", "w").close()
            if start == 6 * HOUR and not asked:
                raise OSError("lost")
            yield from klines(symbol, timeframe, start, end)

        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
        print("ROWS", paged.read_pages(spark, fetch, [("a", "1h", 0, 12 * HOUR)], 3 * HOUR).count())
    """)
    root = Path(__file__).resolve().parent.parent
    out = subprocess.run([sys.executable, "-c", script], cwd=root, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(root)})
    assert "ROWS 12" in out.stdout, out.stderr[-2000:]
    asked = [int(f.split("-")[0]) // HOUR for f in os.listdir(tmp_path)]
    assert sorted(asked) == [0, 3, 6, 6, 9]
