"""Queries of events, volatility, barriers, labels and performance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import barriers as bar
from tickloom.operators import events as ev
from tickloom.operators import performance as perf
from tickloom.operators.volatility import volatility
from tickloom.plans import sql as q
from tickloom.plans.queries import BB, SPAN, daily, levels, on_bars, r, register

# events
_EV = "symbol, bar_id, open_time, direction"


def _event(name, build, tables: str, source: str, direction: str, entry: str = "close") -> None:
    register(name, lambda s, d: build(daily(s, d)).select("symbol", "bar_id", "open_time", F.col("direction").cast("int").alias("direction"), r("entry_price")), f"WITH {q.BARS}, {tables}, x AS (SELECT *, {direction} AS direction FROM {source}) SELECT {_EV}, round({entry}, 4) + 0.0 AS entry_price FROM x WHERE direction <> 0")


_event("ev_zscore", ev.zscore, BB, "b2", "CASE WHEN (close - bb_middle) / nullif((bb_upper - bb_middle) / 2, 0) < -2 THEN 1 WHEN (close - bb_middle) / nullif((bb_upper - bb_middle) / 2, 0) > 2 THEN -1 ELSE 0 END")
for mode, sign in (("reversal", -1), ("breakout", 1)):
    _event(f"ev_bollinger_{mode}", lambda b, mode=mode: ev.band_touch(b, mode=mode), BB, "b2", f"CASE WHEN close <= bb_lower THEN {-sign} WHEN close >= bb_upper THEN {sign} ELSE 0 END")
_event(
    "ev_vol_breakout", lambda b: ev.volatility_breakout(b, 20, 1.0, 1.2), f"{BB}, vb AS (SELECT *, bb_middle + 1.0 * dev AS u1, bb_middle - 1.0 * dev AS d1, {q.rolling('avg', 'volume', 20)} AS vm FROM b2)", "vb",
    "CASE WHEN low < d1 AND volume > 1.2 * vm THEN -1 WHEN high > u1 AND volume > 1.2 * vm THEN 1 ELSE 0 END",
)
PREV = f"{levels(SPAN)}, pv AS (SELECT *, lag(resistance) OVER ({q.BY}) AS pr, lag(support) OVER ({q.BY}) AS ps FROM lv)"
_GONE = {"up": "(pr IS NOT NULL AND resistance IS NULL AND high >= pr)", "down": "(ps IS NOT NULL AND support IS NULL AND low <= ps)"}
_MOVED = {"up": "(pr IS NOT NULL AND resistance IS NOT NULL AND pr <> resistance AND high >= pr)", "down": "(ps IS NOT NULL AND support IS NOT NULL AND ps <> support AND low <= ps)"}
BREAK = {k: {"ignore": _GONE[k], "only": _MOVED[k], "include": f"({_GONE[k]} OR {_MOVED[k]})"} for k in _GONE}
for rule in ("ignore", "include", "only"):
    _event(f"ev_sr_{rule}", lambda b, rule=rule: ev.level_break(b, SPAN, rule), PREV, "pv", f"CASE WHEN {BREAK['down'][rule]} THEN -1 WHEN {BREAK['up'][rule]} THEN 1 ELSE 0 END", "CASE WHEN direction = 1 THEN pr ELSE ps END")

SR = f"{PREV}, e0 AS (SELECT *, CASE WHEN {BREAK['down']['include']} THEN -1 WHEN {BREAK['up']['include']} THEN 1 ELSE 0 END AS direction FROM pv), ev AS (SELECT symbol, bar_id, open_time, direction, CASE WHEN direction = 1 THEN pr ELSE ps END AS entry_price FROM e0 WHERE direction <> 0)"
register(
    "ev_delayed_entry", lambda s, d: ev.delayed(ev.level_break(b := daily(s, d), SPAN), b, 2).select("symbol", "bar_id", "open_time", "direction", r("entry_price")),
    f"WITH {q.BARS}, {SR} SELECT b.symbol, b.bar_id, b.open_time, ev.direction, round(b.close, 4) + 0.0 AS entry_price FROM ev JOIN bars b ON b.symbol = ev.symbol AND b.bar_id = ev.bar_id + 2",
)
register(
    "ev_cusum_fixed", lambda s, d: ev.cusum_filter(daily(s, d), 100_000.0).select("symbol", "bar_id", F.col("direction").cast("int").alias("direction")),
    f"""WITH RECURSIVE {q.BARS}, c AS (
  SELECT symbol, bar_id, close, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS dn, 0 AS direction FROM bars WHERE bar_id = 1
  UNION ALL
  SELECT symbol, bar_id, close, CASE WHEN NOT fall AND u > 100000 THEN 0 ELSE u END, CASE WHEN fall THEN 0 ELSE d END, CASE WHEN fall THEN -1 WHEN u > 100000 THEN 1 ELSE 0 END
  FROM (SELECT b.symbol, b.bar_id, b.close, greatest(0, c.up + b.close - c.close) AS u, least(0, c.dn + b.close - c.close) AS d, least(0, c.dn + b.close - c.close) < -100000 AS fall FROM c JOIN bars b ON b.symbol = c.symbol AND b.bar_id = c.bar_id + 1))
SELECT symbol, bar_id, direction FROM c WHERE direction <> 0""",
)
# exponential sums of weights, values and squares give the deviation of weights that fade
_EWM = f"""rt AS (SELECT *, close / nullif(lag(close) OVER ({q.BY}), 0) - 1 AS ret FROM bars), ew AS (
  SELECT symbol, bar_id, ret, CAST(0 AS DOUBLE) AS sw, CAST(0 AS DOUBLE) AS sww, CAST(0 AS DOUBLE) AS sx, CAST(0 AS DOUBLE) AS sxx FROM rt WHERE bar_id = 1
  UNION ALL
  SELECT r.symbol, r.bar_id, r.ret, e.sw * {{fade}} + 1, e.sww * {{fade}} * {{fade}} + 1, e.sx * {{fade}} + r.ret, e.sxx * {{fade}} + r.ret * r.ret FROM ew e JOIN rt r ON r.symbol = e.symbol AND r.bar_id = e.bar_id + 1),
sd AS (SELECT symbol, bar_id, CASE WHEN bar_id > 2 THEN sqrt(greatest(sxx / sw - pow(sx / sw, 2), 0) * sw * sw / nullif(sw * sw - sww, 0)) END AS dev FROM ew)"""
register(
    "ev_cusum_dynamic", lambda s, d: ev.cusum_filter(daily(s, d), None, 100_000.0).select("symbol", "bar_id", F.col("direction").cast("int").alias("direction")),
    f"""WITH RECURSIVE {q.BARS}, {_EWM.format(fade='(99.0::DOUBLE / 101.0::DOUBLE)')}, th AS (SELECT b.*, sd.dev * 100000 AS lim FROM bars b LEFT JOIN sd USING (symbol, bar_id)), c AS (
  SELECT symbol, bar_id, close, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS dn, 0 AS direction FROM th WHERE bar_id = 1
  UNION ALL
  SELECT symbol, bar_id, close, CASE WHEN NOT fall AND rise THEN 0 ELSE u END, CASE WHEN fall THEN 0 ELSE d END, CASE WHEN fall THEN -1 WHEN rise THEN 1 ELSE 0 END
  FROM (SELECT *, coalesce(d < -lim, false) AS fall, coalesce(u > lim, false) AS rise FROM (SELECT b.symbol, b.bar_id, b.close, b.lim, greatest(0, c.up + b.close - c.close) AS u, least(0, c.dn + b.close - c.close) AS d FROM c JOIN th b ON b.symbol = c.symbol AND b.bar_id = c.bar_id + 1)))
SELECT symbol, bar_id, direction FROM c WHERE direction <> 0""",
)

# volatility
RET = f"rt AS (SELECT *, close / nullif(lag(close) OVER ({q.BY}), 0) - 1 AS ret FROM bars)"
_V = {"sigma": 6}
on_bars("vol_std", _V, lambda b: volatility(b, "std"), f"{RET}, o AS (SELECT *, {q.rolling('stddev_samp', 'ret', 20)} AS sigma FROM rt)")


def _clipped(source: str, low: str, high: str, x: str = "ret") -> str:
    part = "OVER (PARTITION BY symbol)"
    return f"qc AS (SELECT *, greatest(quantile_cont({x}, {low}) {part}, least(quantile_cont({x}, {high}) {part}, {x})) AS cut0, {x} AS x0 FROM {source}), ct AS (SELECT *, CASE WHEN x0 IS NOT NULL THEN cut0 END AS cut FROM qc)"


_EWM_END = f"s2 AS (SELECT *, cut * cut AS sq FROM ct), {q.ewm('e', 's2', 'sq', '2/51.0::DOUBLE')}, o AS (SELECT symbol, bar_id, sqrt(v) AS sigma FROM e)"
on_bars("vol_bar_ewm", _V, lambda b: volatility(b, "bar_ewm"), f"{RET}, r0 AS (SELECT * REPLACE (coalesce(ret, 0) AS ret) FROM rt), {_clipped('r0', '0.005', '0.995')}, {_EWM_END}")
on_bars("vol_bar_volnorm_ewm", _V, lambda b: volatility(b, "bar_volnorm_ewm"), f"{RET}, r0 AS (SELECT * REPLACE (coalesce(ret, 0) / sqrt(greatest(volume / median(volume) OVER (PARTITION BY symbol), 1e-12)) AS ret) FROM rt), {_clipped('r0', '0.005', '0.995')}, {_EWM_END}")
on_bars("vol_winsor_std", _V, lambda b: volatility(b, "winsor_std"), f"{RET}, {_clipped('rt', '0.01', '0.99')}, o AS (SELECT *, {q.rolling('stddev_samp', 'cut', 20)} AS sigma FROM ct)")
on_bars("vol_mad", _V, lambda b: volatility(b, "mad"), f"{RET}, m1 AS (SELECT *, abs(ret - ({q.rolling('median', 'ret', 20)})) AS dist FROM rt), o AS (SELECT *, 1.4826 * ({q.rolling('median', 'dist', 20)}) AS sigma FROM m1)")
on_bars(
    "vol_biweight", _V, lambda b: volatility(b, "biweight"),
    f"""{RET}, h AS (SELECT *, list(ret) FILTER (ret IS NOT NULL) {q.rows(20)} AS held FROM rt), m1 AS (SELECT *, CASE WHEN len(held) = 20 THEN list_median(held) END AS med FROM h), m2 AS (SELECT *, CASE WHEN med IS NOT NULL THEN list_median(list_transform(held, lambda x: abs(x - med))) END AS mad FROM m1),
    w AS (SELECT *, list_transform(held, lambda x: CASE WHEN pow((x - med) / (9 * (1.4826 * mad + 1e-12)), 2) < 1 THEN pow(1 - pow((x - med) / (9 * (1.4826 * mad + 1e-12)), 2), 2) ELSE 0 END) AS ws FROM m2),
    o AS (SELECT *, CASE WHEN mad IS NOT NULL THEN sqrt(list_sum(list_transform(held, lambda x, i: pow(x - med, 2) * ws[i])) / greatest(list_sum(ws) - 1e-12, 1e-12)) END AS sigma FROM w)""",
)
_GK = "0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2)"
_TERMS = {"parkinson": "pow(ln(high / low), 2) / (4 * ln(2))", "garman_klass": _GK, "rogers_satchell": "ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)"}
for method, term in _TERMS.items():
    on_bars(f"vol_{method}", _V, lambda b, method=method: volatility(b, method), f"t0 AS (SELECT *, {term} AS term FROM bars), t1 AS (SELECT *, {q.rolling('avg', 'term', 20)} AS a FROM t0), o AS (SELECT *, CASE WHEN a IS NOT NULL THEN sqrt(greatest(a, 0)) END AS sigma FROM t1)")
on_bars("vol_yang_zhang", _V, lambda b: volatility(b, "yang_zhang"), f"t0 AS (SELECT *, pow(ln(lag(open) OVER ({q.BY}) / open), 2) AS oo, pow(ln(close / open), 2) AS oc, {_GK} AS gk FROM bars), t1 AS (SELECT *, ({q.rolling('avg', 'oo', 20)}) + 0.34 * ({q.rolling('avg', 'oc', 20)}) + 0.66 * ({q.rolling('avg', 'gk', 20)}) AS a FROM t0), o AS (SELECT *, CASE WHEN a IS NOT NULL THEN sqrt(greatest(a, 0)) END AS sigma FROM t1)")
# mean and variance by their recurrences, corrected by the sum of squared weights
on_bars(
    "vol_ewm_std", _V, lambda b: volatility(b, "ewm_std"),
    f"""{RET}, es AS (SELECT symbol, bar_id, ret AS m, CAST(0 AS DOUBLE) AS v, CAST(1 AS DOUBLE) AS ww FROM rt WHERE bar_id = 2
      UNION ALL SELECT b.symbol, b.bar_id, e.m + 2 / 21.0::DOUBLE * (b.ret - e.m), 19 / 21.0::DOUBLE * (e.v + 2 / 21.0::DOUBLE * pow(b.ret - e.m, 2)), pow(19 / 21.0::DOUBLE, 2) * e.ww + pow(2 / 21.0::DOUBLE, 2) FROM es e JOIN rt b ON b.symbol = e.symbol AND b.bar_id = e.bar_id + 1),
    o AS (SELECT b.symbol, b.bar_id, CASE WHEN ww < 1 THEN sqrt(v / (1 - ww)) END AS sigma FROM bars b LEFT JOIN es USING (symbol, bar_id))""",
)
on_bars("vol_bar_ewm_abs", _V, lambda b: volatility(b, "bar_ewm", absolute=True), f"{RET}, r0 AS (SELECT * REPLACE (coalesce(ret, 0) AS ret) FROM rt), {_clipped('r0', '0.005', '0.995')}, {_EWM_END.replace('cut * cut', 'abs(cut)')}")
on_bars(
    "vol_bar_volnorm_ewm_ref", _V, lambda b: volatility(b, "bar_volnorm_ewm", reference="ewm"),
    f"{RET}, {q.ewm('rf', 'rt', 'volume', '2/201.0::DOUBLE')}, r0 AS (SELECT rt.* REPLACE (coalesce(ret, 0) / sqrt(greatest(volume / rf.v, 1e-12)) AS ret) FROM rt JOIN rf USING (symbol, bar_id)), {_clipped('r0', '0.005', '0.995')}, {_EWM_END}",
)

# barriers and labels
HOLD = 20
SIGMA = f"{SR}, {RET}, vol AS (SELECT symbol, bar_id, {q.rolling('stddev_samp', 'ret', 20)} AS sigma FROM rt), es AS (SELECT ev.*, first_value(vol.sigma IGNORE NULLS) OVER (PARTITION BY ev.symbol ORDER BY ev.bar_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sigma FROM ev LEFT JOIN vol USING (symbol, bar_id))"
HB = f"{SIGMA}, hb AS (SELECT *, entry_price * (1 + direction * greatest(2 * sigma, 0.001)) AS pt0, entry_price * (1 - direction * greatest(2 * sigma, 0.001)) AS sl0 FROM es), hz AS (SELECT * EXCLUDE (pt0, sl0), CASE WHEN sigma IS NOT NULL THEN pt0 END AS pt, CASE WHEN sigma IS NOT NULL THEN sl0 END AS sl FROM hb)"
VB = f"{HB}, lb AS (SELECT symbol, max(bar_id) AS last_bar FROM bars GROUP BY 1), vb AS (SELECT hz.*, least(bar_id + {HOLD}, last_bar) AS t1 FROM hz JOIN lb USING (symbol))"


def _sr_events(s, d):
    b = daily(s, d)
    return b, bar.vertical(bar.horizontal(ev.level_break(bar.prepared(b, "std", 20), SPAN), b, "std", 20), b, HOLD)


register("barriers_horizontal", lambda s, d: _sr_events(s, d)[1].select("symbol", "bar_id", "direction", r("entry_price"), r("sigma", 6), r("pt"), r("sl")), f"WITH {q.BARS}, {HB} SELECT symbol, bar_id, direction, round(entry_price, 4) + 0.0 AS entry_price, round(sigma, 6) + 0.0 AS sigma, round(pt, 4) + 0.0 AS pt, round(sl, 4) + 0.0 AS sl FROM hz")
register("barriers_vertical", lambda s, d: _sr_events(s, d)[1].select("symbol", "bar_id", "t1"), f"WITH {q.BARS}, {VB} SELECT symbol, bar_id, t1 FROM vb")


def touched(high: str, low: str) -> str:
    return f"""{VB}, hit AS (SELECT v.symbol, v.bar_id, min_by(CASE WHEN b.{high} >= CASE WHEN direction = 1 THEN pt ELSE sl END THEN 1 ELSE -1 END, b.bar_id) AS side, min(b.bar_id) AS spot
    FROM vb v JOIN bars b ON b.symbol = v.symbol AND b.bar_id BETWEEN v.bar_id AND v.t1 AND pt IS NOT NULL AND sl IS NOT NULL AND (b.{high} >= CASE WHEN direction = 1 THEN pt ELSE sl END OR b.{low} <= CASE WHEN direction = 1 THEN sl ELSE pt END) GROUP BY 1, 2),
    tr0 AS (SELECT v.*, coalesce(side * direction, 0) AS bin, coalesce(spot, t1) AS exit_bar, CASE WHEN side = 1 THEN CASE WHEN direction = 1 THEN pt ELSE sl END WHEN side = -1 THEN CASE WHEN direction = 1 THEN sl ELSE pt END ELSE b.close END AS exit_price
    FROM vb v LEFT JOIN hit USING (symbol, bar_id) JOIN bars b ON b.symbol = v.symbol AND b.bar_id = v.t1), tr AS (SELECT *, (exit_price - entry_price) / nullif(entry_price, 0) * direction AS r_target FROM tr0 WHERE exit_bar <> bar_id)"""


_TRADE = "symbol, bar_id, direction, CAST(bin AS INT) AS bin, exit_bar, round(exit_price, 4) + 0.0 AS exit_price, round(r_target, 6) + 0.0 AS r_target"


def _labels(s, d, high_low: bool):
    b, e = _sr_events(s, d)
    return bar.first_touch(e, b, HOLD, high_low).select("symbol", "bar_id", "direction", "bin", "exit_bar", r("exit_price"), r("r_target", 6))


register("labels_first_touch_hl", lambda s, d: _labels(s, d, True), f"WITH {q.BARS}, {touched('high', 'low')} SELECT {_TRADE} FROM tr")
register("labels_first_touch_close", lambda s, d: _labels(s, d, False), f"WITH {q.BARS}, {touched('close', 'close')} SELECT {_TRADE} FROM tr")


def _trail(s, d):
    b, e = _sr_events(s, d)
    return bar.trailing(e.select("symbol", "bar_id", "t1"), b, HOLD, 0.02).select("symbol", "bar_id", "exit_bar", r("exit_price"), F.size("stop_path").alias("n_path"))


register(
    "labels_trailing", _trail,
    f"""WITH {q.BARS}, {VB}, p AS (SELECT v.symbol, v.bar_id, b.bar_id AS spot, b.close, max(b.close) OVER (PARTITION BY v.symbol, v.bar_id ORDER BY b.bar_id) * (1 - 0.02) AS stop FROM vb v JOIN bars b ON b.symbol = v.symbol AND b.bar_id BETWEEN v.bar_id AND v.t1)
    SELECT symbol, bar_id, min(spot) FILTER (close <= stop) AS exit_bar, round(min_by(close, spot) FILTER (close <= stop), 4) + 0.0 AS exit_price, CAST(count(*) AS INT) AS n_path FROM p GROUP BY 1, 2""",
)


def _legacy(s, d):
    b, e = _sr_events(s, d)
    return bar.legacy(e, b, HOLD).select("symbol", "bar_id", "bin", "exit_bar", r("exit_price"))


register(
    "labels_legacy", _legacy,
    f"""WITH {q.BARS}, {VB}, p AS (SELECT v.symbol, v.bar_id, v.t1, v.pt, v.sl, b.bar_id AS spot, b.close FROM vb v JOIN bars b ON b.symbol = v.symbol AND b.bar_id BETWEEN v.bar_id AND v.t1),
    g AS (SELECT symbol, bar_id, t1, pt, sl, min(spot) FILTER (close >= pt OR close <= sl) AS spot, min_by(close, spot) FILTER (close >= pt OR close <= sl) AS c, max_by(close, spot) AS last FROM p GROUP BY ALL)
    SELECT symbol, bar_id, CAST(CASE WHEN spot IS NULL THEN 0 WHEN c >= pt THEN 1 ELSE -1 END AS INT) AS bin, coalesce(spot, t1) AS exit_bar, round(CASE WHEN spot IS NULL THEN last WHEN c >= pt THEN pt ELSE sl END, 4) + 0.0 AS exit_price FROM g""",
)
TRADES = touched("high", "low")


def trades(s, d):
    return bar.sr_trades(daily(s, d), SPAN, HOLD)


_STATS = ["profit_share", "loss_share", "time_share", "win_loss_ratio"]
_STATS_SQL = "SELECT symbol, count(*) AS n_trades, count(*) FILTER (bin = 1) AS n_profit, count(*) FILTER (bin = -1) AS n_loss, count(*) FILTER (bin = 0) AS n_time, round(count(*) FILTER (bin = 1) / count(*), 6) AS profit_share, round(count(*) FILTER (bin = -1) / count(*), 6) AS loss_share, round(count(*) FILTER (bin = 0) / count(*), 6) AS time_share, CASE WHEN count(*) FILTER (bin = 1) > 0 THEN round(count(*) FILTER (bin = -1) / count(*) FILTER (bin = 1), 6) ELSE CAST('inf' AS DOUBLE) END AS win_loss_ratio FROM tr GROUP BY 1"
stats = lambda s, d: perf.trade_stats(trades(s, d)).select("symbol", "n_trades", "n_profit", "n_loss", "n_time", *[r(c, 6) for c in _STATS])
register("pipeline_sr_trades", stats, f"WITH {q.BARS}, {TRADES} {_STATS_SQL}")
register("trade_stats", lambda s, d: perf.trade_stats(_close_trades(s, d)).select("symbol", "n_trades", "n_profit", "n_loss", "n_time", *[r(c, 6) for c in _STATS]), f"WITH {q.BARS}, {touched('close', 'close')} {_STATS_SQL}")


def _close_trades(s, d):
    b, e = _sr_events(s, d)
    return bar.first_touch(e, b, HOLD, False)


# performance, over labels by closes
T = f"WITH {q.BARS}, {touched('close', 'close')}, rr AS (SELECT *, (exit_price - entry_price) / nullif(entry_price, 0) * direction AS ret FROM tr)"
_rets = lambda s, d: perf.trade_returns(_close_trades(s, d))
PY = perf.periods_per_year("1D")
register("perf_returns", lambda s, d: _rets(s, d).select("symbol", "bar_id", r("ret", 6)), f"{T} SELECT symbol, bar_id, round(ret, 6) + 0.0 AS ret FROM rr")
EQ = f"{T}, eq AS (SELECT *, product(1 + coalesce(ret, 0)) {q.RUNNING} AS equity FROM rr), dd AS (SELECT *, max(equity) {q.RUNNING} AS peak FROM eq), de AS (SELECT *, equity / peak - 1 AS drawdown FROM dd)"
register("perf_equity", lambda s, d: perf.equity(_rets(s, d)).select("symbol", "bar_id", F.signum("equity").alias("sign"), F.round(F.log(F.abs("equity")), 6).alias("log_equity"), r("drawdown", 6)), f"{EQ} SELECT symbol, bar_id, sign(equity)::DOUBLE AS sign, CASE WHEN equity <> 0 THEN round(ln(abs(equity)), 6) END AS log_equity, round(drawdown, 6) + 0.0 AS drawdown FROM de")
register("perf_drawdown", lambda s, d: perf.max_drawdown(_rets(s, d)).select("symbol", r("max_drawdown", 6), "peak_at", "trough"), f"{EQ}, lo AS (SELECT symbol, min(drawdown) AS max_drawdown, min_by(bar_id, (drawdown, bar_id)) AS trough, min_by(peak, (drawdown, bar_id)) AS pk FROM de GROUP BY 1) SELECT lo.symbol, round(max_drawdown, 6) + 0.0 AS max_drawdown, min(de.bar_id) AS peak_at, trough FROM lo JOIN de ON de.symbol = lo.symbol AND de.equity = pk AND de.bar_id <= trough GROUP BY ALL")
_BASIC = "count(ret) AS n_trades, round(100 * avg((ret > 0)::INT), 6) AS win_rate, CASE WHEN coalesce(sum(-ret) FILTER (ret < 0), 0) > 0 THEN round(coalesce(sum(ret) FILTER (ret > 0), 0) / sum(-ret) FILTER (ret < 0), 6) WHEN sum(ret) FILTER (ret > 0) > 0 THEN CAST('inf' AS DOUBLE) END AS profit_factor, round(avg(ret) * 365 / (stddev_samp(ret) * sqrt(365)), 6) + 0.0 AS sharpe"
register("perf_basic", lambda s, d: perf.basic(_rets(s, d), PY).select("symbol", "n_trades", r("win_rate", 6), r("profit_factor", 6), r("sharpe", 6)), f"{T} SELECT symbol, {_BASIC} FROM rr GROUP BY 1")
register("perf_sharpe", lambda s, d: _rets(s, d).groupBy("direction").agg(F.round(perf.sharpe(F.col("ret"), PY, 0.02), 6).alias("sharpe")), f"{T} SELECT direction, round((avg(ret) * 365 - 0.02) / (stddev_samp(ret) * sqrt(365)), 6) + 0.0 AS sharpe FROM rr GROUP BY 1")
_DET = ["annual_return", "annual_volatility", "avg_win", "avg_loss", "max_win", "max_loss"]
register("perf_detailed", lambda s, d: perf.detailed(_rets(s, d), PY).select("symbol", *[r(c, 6) for c in _DET]), f"{T} SELECT symbol, round(avg(ret) * 365, 6) AS annual_return, round(stddev_samp(ret) * sqrt(365), 6) AS annual_volatility, round(coalesce(avg(ret) FILTER (ret > 0), 0), 6) AS avg_win, round(coalesce(avg(ret) FILTER (ret < 0), 0), 6) AS avg_loss, round(coalesce(max(ret) FILTER (ret > 0), 0), 6) AS max_win, round(coalesce(min(ret) FILTER (ret < 0), 0), 6) AS max_loss FROM rr GROUP BY 1")
register("perf_streaks", lambda s, d: perf.streaks(_rets(s, d)), f"{T}, sg AS (SELECT symbol, bar_id, sign(ret) AS sg FROM rr), rn AS (SELECT *, row_number() OVER ({q.BY}) - row_number() OVER (PARTITION BY symbol, sg ORDER BY bar_id) AS g FROM sg), c AS (SELECT symbol, sg, count(*) AS n FROM rn GROUP BY symbol, sg, g) SELECT symbol, coalesce(max(n) FILTER (sg = 1), 0) AS max_wins, coalesce(max(n) FILTER (sg = -1), 0) AS max_losses FROM c GROUP BY 1")
register("perf_duration", lambda s, d: perf.average_duration(_close_trades(s, d)).select("symbol", r("avg_duration", 6)), f"{T} SELECT symbol, round(avg(exit_bar - bar_id) FILTER (exit_bar > bar_id), 6) AS avg_duration FROM rr GROUP BY 1")
