"""Queries that run a symbol in several pieces; their oracles are those of the same results over whole symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import orders, pieces, scans
from tickloom.functions.windows import EPS, change
from tickloom.operators import barriers, events, filters, levels
from tickloom.operators import indicators as ind
from tickloom.plans import signal_queries  # noqa: F401  (its oracles)
from tickloom.plans import sql as q
from tickloom.plans.queries import ORACLES, daily, hourly, r, register
from tickloom.sources import bars as src
from tickloom.sources import paged

#: Rows of a piece here, so that the symbols of the test tables have several.
ROWS = 500


def _bollinger(s, d) -> DataFrame:
    out = pieces.split(daily(s, d), ind.bollinger, back=19, rows=ROWS)
    return out.select("symbol", "bar_id", r("bb_middle"), r("bb_upper"), r("bb_lower"))


register("ind_bollinger_pieces", _bollinger, ORACLES["ind_bollinger"])


def _rsi(s, d) -> DataFrame:
    moves = lambda b: b.withColumn("delta", F.coalesce(change("close"), F.lit(0.0)))
    out = pieces.split(daily(s, d), moves, back=1, rows=ROWS).withColumns({"gain": F.greatest(F.col("delta"), F.lit(0.0)), "loss": F.greatest(-F.col("delta"), F.lit(0.0))})
    out = scans.ewm_mean(out, {"avg_gain": ("gain", 1 / 14), "avg_loss": ("loss", 1 / 14)}, ROWS)
    out = out.withColumn("rsi", 100 - 100 / (1 + F.col("avg_gain") / (F.col("avg_loss") + EPS)))
    return out.select("symbol", "bar_id", r("rsi", 6), (F.round(F.col("rsi") / 100, 6) + 0.0).alias("rsi_norm"))


register("ind_rsi_pieces", _rsi, ORACLES["ind_rsi"])


def _vwap(s, d) -> DataFrame:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    out = pieces.running(daily(s, d).withColumn("value", typical * F.col("volume")), {"value_sum": ("sum", "value"), "volume_sum": ("sum", "volume")}, ROWS)
    vwap = F.col("value_sum") / (F.col("volume_sum") + EPS)
    return out.withColumn("vwap_distance", (F.col("close") - vwap) / (vwap + EPS)).select("symbol", "bar_id", r("vwap_distance", 6))


register("ind_vwap_distance_pieces", _vwap, ORACLES["ind_vwap_distance"])


def _cusum(s, d) -> DataFrame:
    out = scans.handed_over(daily(s, d).withColumn("threshold", F.lit(100_000.0)), {"direction": "long"}, events.cusum_step, events.CUSUM_START, ROWS)
    return out.where("direction <> 0").select("symbol", "bar_id", F.col("direction").cast("int").alias("direction"))


register("ev_cusum_fixed_pieces", _cusum, ORACLES["ev_cusum_fixed"])


def _orders(s, d) -> DataFrame:
    out = orders.rolling_order(daily(s, d), "close", 60, {"middle": "median", "spread": "mad", "upper": 0.9, "rank": "percent_rank"}, ROWS)
    return out.select("symbol", "bar_id", r("middle"), r("spread"), r("upper"), r("rank", 6))


register(
    "win_order_pieces", _orders,
    f"""WITH {q.BARS}, h AS (SELECT *, list(close) {q.rows(60)} AS held FROM bars), m AS (SELECT *, list_median(held) AS mid FROM h WHERE len(held) = 60)
    SELECT b.symbol, b.bar_id, round(mid, 4) + 0.0 AS middle, round(list_median(list_transform(held, lambda x: abs(x - mid))), 4) + 0.0 AS spread, round(list_aggregate(held, 'quantile_cont', 0.9), 4) + 0.0 AS upper,
      round(len(list_filter(held, lambda x: x < b.close)) / 60.0::DOUBLE, 6) + 0.0 AS rank FROM bars b LEFT JOIN m ON m.symbol = b.symbol AND m.bar_id = b.bar_id""",
)
register("sadf_pieces", lambda s, d: filters.sadf(hourly(s, d).withColumn("close", F.log("close")), rows=200).select("symbol", "bar_id", r("sadf", 4)), ORACLES["sadf"])


def _density(s, d) -> DataFrame:
    return levels.density(daily(s, d), ["symbol"], "close", 0.0005, 3).select("symbol", "bar_id", "cluster")


register(
    "levels_density", _density,
    f"""WITH {q.BARS}, p AS (SELECT symbol, bar_id, close / (avg(close) OVER (PARTITION BY symbol) * 0.0005::DOUBLE) AS u FROM bars),
    c AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY u RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) >= 3 THEN u END AS core FROM p),
    n AS (SELECT *, last_value(core IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo, first_value(core IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM c WINDOW w AS (PARTITION BY symbol ORDER BY u, bar_id)),
    s AS (SELECT *, sum(CASE WHEN core IS NOT NULL AND NOT coalesce(u - lo <= 1, false) THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY u, bar_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS begun FROM n)
    SELECT symbol, bar_id, CAST(begun - 1 + CASE WHEN core IS NULL AND NOT coalesce(u - lo <= 1, false) AND (lo IS NULL OR hi - lo > 1) THEN 1 ELSE 0 END AS BIGINT) AS cluster FROM s
    WHERE core IS NOT NULL OR coalesce(u - lo <= 1, false) OR coalesce(hi - u <= 1, false)""",
)


def _paged(s, d) -> DataFrame:
    path, bars = pieces.shared_path(s, "pages"), hourly(s, d)
    paged.store_pages(bars, "1h", path)
    ms = F.unix_millis(F.col("open_time").cast("timestamp"))
    # one job for each symbol; pages are the partitions
    jobs = [(x["symbol"], "1h", x["a"], x["b"] + 1) for x in bars.groupBy("symbol").agg(F.min(ms).alias("a"), F.max(ms).alias("b")).collect()]
    return paged.read_pages(s, paged.stored_pages(path), jobs).select("symbol", "open_time", *[r(F.col(c).cast("double"), 3).alias(c) for c in ("open", "high", "low", "close", "volume")])


register("bars_paged", _paged, f"WITH {q.HOURLY} SELECT symbol, open_time, {', '.join(f'round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 3) + 0.0 AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM hourly")


# filters with the memory of the filter on both sides of each piece
for _name, _form, _column, _digits in (
    ("flt_hp", lambda b: filters.hodrick_prescott(b, rows=ROWS), ("trend", "cycle"), 2),
    ("flt_butter", lambda b: filters.butterworth(b, rows=ROWS), ("butter",), 3),
    ("flt_wavelet", lambda b: filters.wavelet(b, rows=ROWS), ("wavelet",), 6),
):
    register(f"{_name}_pieces", lambda s, d, form=_form, columns=_column, digits=_digits: form(daily(s, d)).select("symbol", "bar_id", *[r(c, digits) for c in columns]), ORACLES[_name])


def _stored(s, d):
    """Bars of two timeframes written by series and read back, one series in a second call."""
    path = pieces.shared_path(s, "bars")
    both = daily(s, d).withColumn("timeframe", F.lit("1d")).unionByName(hourly(s, d).withColumn("timeframe", F.lit("1h")))
    src.save_bars(both.where("symbol <> '2-HIGH'"), path)
    src.save_bars(both.withColumn("close", F.when(F.col("symbol") == "2-HIGH", F.col("close")).otherwise(0.0)), path)
    return src.load_bars(s, path).groupBy("timeframe", "symbol").agg(F.count("*").alias("n"), F.sum("close").alias("total")).select("timeframe", "symbol", "n", r("total", 4))


register("bars_stored", _stored, f"WITH {q.BARS}, {q.HOURLY} SELECT '1d' AS timeframe, symbol, count(*) AS n, round(sum(close), 4) + 0.0 AS total FROM bars GROUP BY symbol UNION ALL SELECT '1h', symbol, count(*), round(sum(close), 4) + 0.0 FROM hourly GROUP BY symbol")
_some = lambda b: b.where("bar_id % 7 = 3").select("symbol", "bar_id", F.when(F.col("bar_id") % 2 == 0, F.col("high")).alias("entry_price"))
register("barriers_fill_entry", lambda s, d: barriers.fill_entry(_some(b := daily(s, d)), b, "open").select("symbol", "bar_id", "entry_price"), f"WITH {q.BARS} SELECT symbol, bar_id, CASE WHEN bar_id % 2 = 0 THEN high ELSE open END AS entry_price FROM bars WHERE bar_id % 7 = 3")
register("flt_min_max", lambda s, d: filters.min_max(daily(s, d), "close", "scaled").select("symbol", "bar_id", r("scaled", 8)), f"WITH {q.BARS} SELECT symbol, bar_id, round((close - min(close) OVER w) / (max(close) OVER w - min(close) OVER w), 8) + 0.0 AS scaled FROM bars WINDOW w AS (PARTITION BY symbol)")
