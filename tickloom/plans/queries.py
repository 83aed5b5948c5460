"""Registered queries over the test tables, each with its oracle SQL where SQL can express it.

Prices are rounded to 4 places and ratios to 6 in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import indicators as ind
from tickloom.plans import sql as q
from tickloom.sources import bars as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.daily_bars(table(spark, sf_dir, "orders"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.hourly_bars(table(spark, sf_dir, "events"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.ticks_from(table(spark, sf_dir, "events"))


def r(column: str | Column, places: int = 4) -> Column:
    """Rounded, without negative zero."""
    name = column if isinstance(column, str) else None
    out = F.round(F.col(column) if name else column, places) + F.lit(0.0)
    return out.alias(name) if name else out


def register(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def on_bars(name: str, columns: dict[str, int], build: Callable[[DataFrame], DataFrame], oracle: str | None) -> None:
    """A query of rounded columns over the daily bars; ``oracle``: tables ending in ``o``."""
    register(name, lambda s, d: build(daily(s, d)).select("symbol", "bar_id", *[r(c, p) for c, p in columns.items()]))
    if oracle:
        picked = ", ".join(f"round({c}, {p}) + 0.0 AS {c}" for c, p in columns.items())
        ORACLES[name] = f"WITH RECURSIVE {q.BARS}, {oracle} SELECT symbol, bar_id, {picked} FROM o"


OHLCV = ["symbol", "bar_id", "open_time", "open", "high", "low", "close", "volume"]
register("bars_daily", daily, f"WITH {q.BARS} SELECT * FROM bars")
register("bars_hourly", hourly, f"WITH {q.HOURLY} SELECT * FROM hourly")


def _resampled(bucket: str) -> str:
    return f"""WITH {q.HOURLY} SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS BIGINT) AS bar_id, open_time, open, high, low, close, volume FROM (
SELECT symbol, {bucket} AS open_time, min_by(open, bar_id) AS open, max(high) AS high, min(low) AS low, max_by(close, bar_id) AS close, sum(volume) AS volume FROM hourly GROUP BY 1, 2)"""


register("bars_resample_4h", lambda s, d: src.resample(hourly(s, d), src.hours_bucket(4)), _resampled("CAST(time_bucket(INTERVAL 4 HOUR, open_time, TIMESTAMP '2000-01-01') AS TIMESTAMP)"))
register("bars_resample_week", lambda s, d: src.resample(hourly(s, d), F.date_trunc("week", "open_time")), _resampled("CAST(date_trunc('week', open_time) AS TIMESTAMP)"))
register("source_date_filter", lambda s, d: daily(s, d).where(F.col("open_time").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1996-06-30").cast("timestamp_ntz"))), f"WITH {q.BARS} SELECT * FROM bars WHERE open_time BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-06-30'")
register("source_symbol_catalog", lambda s, d: src.available_symbols(daily(s, d)), f"WITH {q.BARS} SELECT DISTINCT symbol FROM bars")
register("data_info", lambda s, d: src.data_info(daily(s, d)).drop("n_columns"), f"WITH {q.BARS} SELECT symbol, min(open_time) AS start_time, max(open_time) AS end_time, count(*) AS n_bars FROM bars GROUP BY 1")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as market symbols: quote asset by region."""
    regions = table(spark, sf_dir, "region").select("r_regionkey", F.when(F.col("r_regionkey") == 0, "USDT").when(F.col("r_regionkey") == 1, "BTC").when(F.col("r_regionkey") == 2, "EUR").otherwise("ETH").alias("quote_asset"))
    return table(spark, sf_dir, "nation").join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey")).select(F.upper("n_name").alias("symbol"), "quote_asset")


CATALOG = "catalog AS (SELECT upper(n_name) AS symbol, CASE n_regionkey WHEN 0 THEN 'USDT' WHEN 1 THEN 'BTC' WHEN 2 THEN 'EUR' ELSE 'ETH' END AS quote_asset FROM nation)"
CATEGORIES = f"{CATALOG}, c AS (SELECT symbol, quote_asset, CASE WHEN quote_asset IN ('USDT','BTC','ETH','BNB','BUSD','USDC') THEN quote_asset || '_PAIR' ELSE 'OTHER' END AS category FROM catalog)"
register("symbols_categorize", lambda s, d: src.categorize(catalog(s, d)), f"WITH {CATEGORIES} SELECT * FROM c")
register("symbols_statistics", lambda s, d: src.symbol_statistics(src.categorize(catalog(s, d)), "category"), f"WITH {CATEGORIES} SELECT category AS value, count(*) AS n_symbols FROM c GROUP BY 1")

# indicators
on_bars("ind_sma", {"sma_20": 4}, ind.sma, f"o AS (SELECT *, avg(close) {q.rows(20)} AS sma_20 FROM bars)")
BB = f"bb AS (SELECT *, {q.rolling('avg', 'close', 20)} AS bb_middle, {q.rolling('stddev_samp', 'close', 20)} AS dev FROM bars), b2 AS (SELECT *, bb_middle + 2 * dev AS bb_upper, bb_middle - 2 * dev AS bb_lower FROM bb)"
on_bars("ind_bollinger", {"bb_middle": 4, "bb_upper": 4, "bb_lower": 4}, ind.bollinger, f"{BB}, o AS (SELECT * FROM b2)")
on_bars("ind_bb_width", {"bb_width": 6}, ind.bollinger_width, f"{BB}, o AS (SELECT *, (bb_upper - bb_lower) / (bb_middle + 1e-9) AS bb_width FROM b2)")
TR = f"tr0 AS (SELECT *, coalesce(lag(close) OVER ({q.BY}), (high + low) / 2) AS pc FROM bars), tr AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM tr0)"
on_bars("ind_atr_sma", {"atr": 4}, lambda b: ind.atr(b, 14, "sma"), f"{TR}, o AS (SELECT *, {q.rolling('avg', 'tr', 14)} AS atr FROM tr)")
on_bars("ind_atr_wilder", {"atr": 4}, ind.atr, f"{TR}, {q.ewm('e', 'tr', 'tr', '1/14.0::DOUBLE')}, o AS (SELECT symbol, bar_id, v AS atr FROM e)")
on_bars("ind_volatility_ratio", {"volatility_ratio": 6}, ind.volatility_ratio, f"{TR}, a AS (SELECT *, {q.rolling('avg', 'tr', 14)} AS atr FROM tr), o AS (SELECT *, ({q.rolling('avg', 'atr', 5)}) / nullif({q.rolling('avg', 'atr', 20)}, 0) AS volatility_ratio FROM a)")
on_bars("ind_volume_ma", {"volume_ma": 6}, ind.volume_ma, f"o AS (SELECT *, {q.rolling('avg', 'volume', 20)} AS volume_ma FROM bars)")
on_bars("ind_vwap_distance", {"vwap_distance": 6}, ind.vwap_distance, f"v AS (SELECT *, sum((high + low + close) / 3 * volume) {q.RUNNING} / (sum(volume) {q.RUNNING} + 1e-9) AS vwap FROM bars), o AS (SELECT *, (close - vwap) / (vwap + 1e-9) AS vwap_distance FROM v)")
on_bars("ind_percent_rank", {"percent_rank": 6}, ind.percent_rank, f"p AS (SELECT *, list(close) {q.rows(20)} AS held FROM bars), o AS (SELECT *, CASE WHEN len(held) = 20 THEN len(list_filter(held, lambda x: x < close)) / 20 END AS percent_rank FROM p)")
RSI = f"d0 AS (SELECT *, coalesce(close - lag(close) OVER ({q.BY}), 0) AS delta FROM bars), d AS (SELECT *, greatest(delta, 0) AS gain, greatest(-delta, 0) AS loss FROM d0), {q.ewm('g', 'd', 'gain', '1/14.0::DOUBLE')}, {q.ewm('l', 'd', 'loss', '1/14.0::DOUBLE')}, rsi AS (SELECT g.symbol, g.bar_id, 100 - 100 / (1 + g.v / (l.v + 1e-9)) AS rsi FROM g JOIN l USING (symbol, bar_id))"
on_bars("ind_rsi", {"rsi": 6, "rsi_norm": 6}, ind.rsi, f"{RSI}, o AS (SELECT *, rsi / 100 AS rsi_norm FROM rsi)")
MACD = f"{q.ewm('f', 'bars', 'close', '2/13.0::DOUBLE')}, {q.ewm('s', 'bars', 'close', '2/27.0::DOUBLE')}, m AS (SELECT f.symbol, f.bar_id, f.v - s.v AS macd_line FROM f JOIN s USING (symbol, bar_id)), {q.ewm('g', 'm', 'macd_line', '2/10.0::DOUBLE')}"
on_bars("ind_macd", {"macd_line": 4, "macd_signal": 4, "macd_hist": 4}, ind.macd, f"{MACD}, o AS (SELECT symbol, bar_id, macd_line, v AS macd_signal, macd_line - v AS macd_hist FROM m JOIN g USING (symbol, bar_id))")
TP = f"t AS (SELECT *, (high + low + close) / 3 AS typical FROM bars), t2 AS (SELECT *, list(typical) {q.rows(20)} AS held, {q.rolling('avg', 'typical', 20)} AS mean FROM t), cci AS (SELECT *, CASE WHEN len(held) = 20 THEN list_avg(list_transform(held, lambda x: abs(x - mean))) END AS mad FROM t2)"
on_bars(
    "ind_norm_momentum", {"rsi_norm": 6, "norm_stoch": 6, "norm_cci": 6}, ind.normalized_momentum,
    f"{RSI}, {TP}, st AS (SELECT *, ({q.rolling('min', 'low', 14)}) AS lo, ({q.rolling('max', 'high', 14)}) AS hi FROM cci), o AS (SELECT st.*, rsi / 100 AS rsi_norm, (close - lo) / (hi - lo + 1e-9) AS norm_stoch, (typical - mean) / (0.015 * mad + 1e-9) / 400 AS norm_cci FROM st JOIN rsi USING (symbol, bar_id))",
)


def levels(span: int) -> str:
    """Oracle tables up to ``lv``: bars with resistance, support and band touches."""
    before, after = f"OVER ({q.BY} ROWS BETWEEN {span} PRECEDING AND 1 PRECEDING)", f"OVER ({q.BY} ROWS BETWEEN 1 FOLLOWING AND {span} FOLLOWING)"
    out = f"""p0 AS (SELECT *, coalesce(count(high) {before} = {span} AND count(high) {after} = {span} AND high >= max(high) {before} AND high >= max(high) {after}, false) AS pivot_high,
    coalesce(count(low) {before} = {span} AND count(low) {after} = {span} AND low <= min(low) {before} AND low <= min(low) {after}, false) AS pivot_low FROM bars),
    l0 AS (SELECT *, sum(pivot_high::INT) {q.RUNNING} AS seg_r, sum(pivot_low::INT) {q.RUNNING} AS seg_s FROM p0)"""
    source = "l0"
    for seg, price, level, sign, band in (("seg_r", "high", "resistance", "", "res"), ("seg_s", "low", "support", "-", "sup")):
        own = f"(PARTITION BY symbol, {seg} ORDER BY bar_id)"
        cum = f"(PARTITION BY symbol, {seg} ORDER BY bar_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        out += f""", {level}1 AS (SELECT *, row_number() OVER {own} AS rn_{band}, CASE WHEN {seg} > 0 THEN first_value({price}) OVER {own} END AS lvl_{band} FROM {source}),
    {level}2 AS (SELECT *, coalesce(bool_or(rn_{band} > 1 AND {sign}({price} - lvl_{band}) > 1e-8) OVER {cum}, false) AS broken_{band} FROM {level}1),
    {level}3 AS (SELECT *, CASE WHEN NOT broken_{band} THEN lvl_{band} END AS {level} FROM {level}2),
    {level}4 AS (SELECT *, coalesce({level} IS NOT NULL AND {sign}({level} - {price}) >= 0 AND {sign}({level} - {price}) <= 2 * 0.01::DOUBLE AND rn_{band} > 1, false) AS {band}_band_hit FROM {level}3),
    {level}5 AS (SELECT *, CAST(sum({band}_band_hit::INT) OVER {cum} AS BIGINT) AS {band}_band_hits FROM {level}4)"""
        source = f"{level}5"
    return f"{out}, lv AS (SELECT * FROM {source})"


SPAN = 5
on_bars("sr_levels", {"resistance": 4, "support": 4}, lambda b: ind.support_resistance(b, SPAN), f"{levels(SPAN)}, o AS (SELECT * FROM lv)")
register("sr_pivots", lambda s, d: ind.support_resistance(daily(s, d), SPAN).select("symbol", "bar_id", "pivot_high", "pivot_low"), f"WITH {q.BARS}, {levels(SPAN)} SELECT symbol, bar_id, pivot_high, pivot_low FROM lv")
TOUCH = ["symbol", "bar_id", "res_band_hit", "res_band_hits", "sup_band_hit", "sup_band_hits"]
register("sr_band_touches", lambda s, d: ind.support_resistance(daily(s, d), SPAN).select(*TOUCH), f"WITH {q.BARS}, {levels(SPAN)} SELECT {', '.join(TOUCH)} FROM lv")
for scale, form in (("raw", "{x}"), ("clip", "CASE WHEN {x} IS NOT NULL THEN greatest(-5, least(5, {x})) END"), ("tanh", "CASE WHEN {x} IS NOT NULL THEN tanh(greatest(-5, least(5, {x})) / 7) END")):
    gaps = [form.format(x=f"((close - {lv}) / (e.v + 1e-9))") for lv in ("resistance", "support")]
    on_bars(f"ind_breakout_gap_{scale}", {"gap_resistance": 6, "gap_support": 6}, lambda b, scale=scale: ind.breakout_gap(b, SPAN, 14, scale), f"{levels(SPAN)}, {TR}, {q.ewm('e', 'tr', 'tr', '1/14.0::DOUBLE')}, o AS (SELECT lv.*, {gaps[0]} AS gap_resistance, {gaps[1]} AS gap_support FROM lv JOIN e USING (symbol, bar_id))")
