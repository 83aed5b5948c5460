"""Queries of the technical-analysis family."""

from __future__ import annotations

from tickloom.operators import ta
from tickloom.plans import sql as q
from tickloom.plans.queries import on_bars


def _logistic(x: str) -> str:
    return f"1 / (1 + exp(-({x})))"


def wilder(name: str, source: str, x: str, n: int, first: int) -> str:
    """Recursive table: mean of n values up to row ``first``, then Wilder's recurrence."""
    return f"""{name} AS (
  SELECT symbol, {first}::BIGINT AS bar_id, avg({x}) AS v FROM {source} WHERE bar_id BETWEEN {first - n + 1} AND {first} GROUP BY symbol HAVING count(*) = {n}
  UNION ALL
  SELECT b.symbol, b.bar_id, (e.v * {n - 1} + b.{x}) / {n} FROM {name} e JOIN {source} b ON b.symbol = e.symbol AND b.bar_id = e.bar_id + 1)"""


def ema(name: str, source: str, x: str, n: int, first: int) -> str:
    return f"""{name} AS (
  SELECT symbol, {first}::BIGINT AS bar_id, avg({x}) AS v FROM {source} WHERE bar_id BETWEEN {first - n + 1} AND {first} GROUP BY symbol HAVING count(*) = {n}
  UNION ALL
  SELECT b.symbol, b.bar_id, e.v + (2 / {n + 1}.0::DOUBLE) * (b.{x} - e.v) FROM {name} e JOIN {source} b ON b.symbol = e.symbol AND b.bar_id = e.bar_id + 1)"""


RANGE14 = f"x AS (SELECT *, ({q.rolling('min', 'low', 14)}) AS lo, ({q.rolling('max', 'high', 14)}) AS hi FROM bars)"
on_bars(
    "ta_stoch", {"ta_stoch_k": 6, "ta_stoch_d": 6}, ta.stochastic,
    f"{RANGE14}, f AS (SELECT *, CASE WHEN hi > lo THEN 100 * (close - lo) / (hi - lo) WHEN hi IS NOT NULL THEN 0 END AS fk FROM x), k AS (SELECT *, {q.rolling('avg', 'fk', 3)} AS sk FROM f), d AS (SELECT *, {q.rolling('avg', 'sk', 3)} AS sd FROM k), o AS (SELECT *, CASE WHEN sd IS NOT NULL THEN sk END / 100 AS ta_stoch_k, sd / 100 AS ta_stoch_d FROM d)",
)
on_bars("ta_willr", {"ta_willr": 6}, ta.williams_r, f"{RANGE14}, o AS (SELECT *, (CASE WHEN hi > lo THEN -100 * (hi - close) / (hi - lo) WHEN hi IS NOT NULL THEN 0 END + 100) / 100 AS ta_willr FROM x)")
on_bars(
    "ta_cci", {"ta_cci": 6}, ta.cci,
    f"t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), h AS (SELECT *, list(tp) {q.rows(14)} AS held, {q.rolling('avg', 'tp', 14)} AS mean FROM t), m AS (SELECT *, CASE WHEN len(held) = 14 THEN list_avg(list_transform(held, lambda x: abs(x - mean))) END AS mad FROM h), o AS (SELECT *, {_logistic('CASE WHEN mad > 0 THEN (tp - mean) / (0.015 * mad) WHEN mad IS NOT NULL THEN 0 END / 100')} AS ta_cci FROM m)",
)
on_bars("ta_roc", {"ta_roc": 6}, ta.roc, f"o AS (SELECT *, {_logistic(f'(close / lag(close, 10) OVER ({q.BY}) - 1) * 100 / 10')} AS ta_roc FROM bars)")
on_bars("ta_mom", {"ta_mom": 6}, ta.momentum, f"o AS (SELECT *, {_logistic(f'(close - lag(close, 10) OVER ({q.BY})) / (avg(close) OVER (PARTITION BY symbol) * 0.01)')} AS ta_mom FROM bars)")
on_bars(
    "ta_aroon", {"ta_aroon_up": 6, "ta_aroon_down": 6}, ta.aroon,
    f"h AS (SELECT *, list_reverse(list(high) {q.rows(15)}) AS hs, list_reverse(list(low) {q.rows(15)}) AS ls FROM bars), o AS (SELECT *, CASE WHEN len(hs) = 15 THEN (14 - (list_position(hs, list_max(hs)) - 1)) / 14 END AS ta_aroon_up, CASE WHEN len(hs) = 15 THEN (14 - (list_position(ls, list_min(ls)) - 1)) / 14 END AS ta_aroon_down FROM h)",
)
_NEAR = lambda c: _logistic(f"10 * ({c} - mean_) / mean_")
on_bars(
    "ta_bbands", {"ta_bb_percent": 6, "ta_bb_upper": 6, "ta_bb_middle": 6, "ta_bb_lower": 6}, ta.bands,
    f"b AS (SELECT *, {q.rolling('avg', 'close', 20)} AS mid, {q.rolling('stddev_pop', 'close', 20)} AS dev, avg(close) OVER (PARTITION BY symbol) AS mean_ FROM bars), c AS (SELECT *, mid + 2 * dev AS up, mid - 2 * dev AS dn FROM b), o AS (SELECT *, (close - dn) / nullif(up - dn, 0) AS ta_bb_percent, {_NEAR('up')} AS ta_bb_upper, {_NEAR('mid')} AS ta_bb_middle, {_NEAR('dn')} AS ta_bb_lower FROM c)",
)
on_bars("ta_stddev", {"ta_stddev": 6}, ta.stddev, f"s AS (SELECT *, ({q.rolling('stddev_pop', 'close', 20)}) / nullif(close, 0) AS x FROM bars), o AS (SELECT *, CASE WHEN x IS NOT NULL THEN greatest(0, least(0.1, x)) / 0.1 END AS ta_stddev FROM s)")
_SCALE = lambda x, name, source: f"o AS (SELECT *, CASE WHEN max({x}) OVER (PARTITION BY symbol) > min({x}) OVER (PARTITION BY symbol) THEN ({x} - min({x}) OVER (PARTITION BY symbol)) / (max({x}) OVER (PARTITION BY symbol) - min({x}) OVER (PARTITION BY symbol)) ELSE 0 END AS {name} FROM {source})"
on_bars("ta_obv", {"ta_obv": 6}, ta.obv, f"s AS (SELECT *, CASE WHEN lag(close) OVER ({q.BY}) IS NULL THEN volume ELSE sign(close - lag(close) OVER ({q.BY})) * volume END AS step FROM bars), v AS (SELECT *, sum(step) {q.RUNNING} AS obv FROM s), {_SCALE('obv', 'ta_obv', 'v')}")
SHARE = "CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END * volume"
on_bars("ta_ad", {"ta_ad": 6}, ta.accumulation, f"s AS (SELECT *, {SHARE} AS mfv FROM bars), v AS (SELECT *, sum(mfv) {q.RUNNING} AS ad FROM s), {_SCALE('ad', 'ta_ad', 'v')}")
on_bars("ta_cmf", {"ta_cmf": 6}, ta.money_flow, f"s AS (SELECT *, {SHARE} AS mfv FROM bars), v AS (SELECT *, ({q.rolling('sum', 'mfv', 20)}) / nullif({q.rolling('sum', 'volume', 20)}, 0) AS f FROM s), o AS (SELECT *, CASE WHEN f IS NOT NULL THEN greatest(0, least(1, (f + 1) / 2)) END AS ta_cmf FROM v)")
on_bars(
    "ta_mfi", {"ta_mfi": 6}, ta.mfi,
    f"t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), m AS (SELECT *, tp - lag(tp) OVER ({q.BY}) AS mv FROM t), f AS (SELECT *, CASE WHEN mv IS NOT NULL THEN CASE WHEN mv > 0 THEN tp * volume ELSE 0 END END AS pf, CASE WHEN mv IS NOT NULL THEN CASE WHEN mv < 0 THEN tp * volume ELSE 0 END END AS nf FROM m), g AS (SELECT *, {q.rolling('sum', 'pf', 14)} AS up, {q.rolling('sum', 'nf', 14)} AS dn FROM f), o AS (SELECT *, CASE WHEN up + dn > 0 THEN up / (up + dn) WHEN up IS NOT NULL THEN 0 END AS ta_mfi FROM g)",
)
D = f"d0 AS (SELECT *, close - lag(close) OVER ({q.BY}) AS dl FROM bars), d AS (SELECT *, greatest(dl, 0) AS up, greatest(-dl, 0) AS dn FROM d0)"
on_bars("ta_rsi", {"ta_rsi": 6}, ta.rsi, f"{D}, {wilder('u', 'd', 'up', 14, 15)}, {wilder('w', 'd', 'dn', 14, 15)}, o AS (SELECT b.*, CASE WHEN u.v + w.v > 0 THEN u.v / (u.v + w.v) WHEN u.v IS NOT NULL THEN 0 END AS ta_rsi FROM bars b LEFT JOIN u USING (symbol, bar_id) LEFT JOIN w USING (symbol, bar_id))")
TR = f"tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({q.BY})), abs(low - lag(close) OVER ({q.BY}))) AS tr FROM bars)"
on_bars("ta_atr", {"ta_atr": 6}, ta.atr, f"{TR}, {wilder('a', 'tr', 'tr', 14, 15)}, o AS (SELECT b.*, CASE WHEN a.v IS NOT NULL THEN greatest(0, least(0.1, a.v / close)) / 0.1 END AS ta_atr FROM bars b LEFT JOIN a USING (symbol, bar_id))")
on_bars(
    "ta_macd", {"ta_macd": 6, "ta_macd_signal": 6, "ta_macd_hist": 6}, ta.macd,
    f"{ema('f', 'bars', 'close', 12, 26)}, {ema('s', 'bars', 'close', 26, 26)}, m AS (SELECT f.symbol, f.bar_id, f.v - s.v AS line FROM f JOIN s USING (symbol, bar_id)), {ema('g', 'm', 'line', 9, 34)}, sp AS (SELECT symbol, (max(close) - min(close)) * 0.01 AS span FROM bars GROUP BY 1), "
    f"o AS (SELECT b.symbol, b.bar_id, {_logistic('line / span')} AS ta_macd, {_logistic('g.v / span')} AS ta_macd_signal, {_logistic('(line - g.v) / span')} AS ta_macd_hist FROM bars b LEFT JOIN (g JOIN m USING (symbol, bar_id) JOIN sp USING (symbol)) USING (symbol, bar_id))",
)
on_bars("ta_trix", {"ta_trix": 6}, ta.trix, f"{ema('e1', 'bars', 'close', 30, 30)}, {ema('e2', 'e1', 'v', 30, 59)}, {ema('e3', 'e2', 'v', 30, 88)}, c AS (SELECT *, (v / lag(v) OVER ({q.BY}) - 1) * 100 AS ch FROM e3), o AS (SELECT b.*, {_logistic('greatest(-700, least(700, ch * 100))')} AS ta_trix FROM bars b LEFT JOIN c USING (symbol, bar_id))".replace("greatest(-700, least(700, ch * 100))", "CASE WHEN ch IS NOT NULL THEN greatest(-700, least(700, ch * 100)) END"))


def _sums(name: str, x: str) -> str:
    return f"""{name} AS (
  SELECT symbol, 15::BIGINT AS bar_id, sum({x}) FILTER (bar_id < 15) - sum({x}) FILTER (bar_id < 15) / 14 + sum({x}) FILTER (bar_id = 15) AS v FROM dm WHERE bar_id BETWEEN 2 AND 15 GROUP BY symbol HAVING count(*) = 14
  UNION ALL
  SELECT b.symbol, b.bar_id, e.v - e.v / 14 + b.{x} FROM {name} e JOIN dm b ON b.symbol = e.symbol AND b.bar_id = e.bar_id + 1)"""


on_bars(
    "ta_adx", {"ta_adx": 6, "ta_plus_di": 6, "ta_minus_di": 6}, ta.adx,
    f"{TR}, mv AS (SELECT *, high - lag(high) OVER ({q.BY}) AS up, lag(low) OVER ({q.BY}) - low AS dn FROM tr), dm AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM mv), "
    f"{_sums('st', 'tr')}, {_sums('sp', 'pdm')}, {_sums('sm', 'mdm')}, di AS (SELECT symbol, bar_id, CASE WHEN st.v > 0 THEN 100 * sp.v / st.v ELSE 0 END AS p, CASE WHEN st.v > 0 THEN 100 * sm.v / st.v ELSE 0 END AS m FROM st JOIN sp USING (symbol, bar_id) JOIN sm USING (symbol, bar_id)), "
    f"dx AS (SELECT *, CASE WHEN p + m > 0 THEN 100 * abs(p - m) / (p + m) ELSE 0 END AS dx FROM di), {wilder('ax', 'dx', 'dx', 14, 28)}, o AS (SELECT b.symbol, b.bar_id, ax.v / 100 AS ta_adx, p / 100 AS ta_plus_di, m / 100 AS ta_minus_di FROM bars b LEFT JOIN di USING (symbol, bar_id) LEFT JOIN ax USING (symbol, bar_id))",
)
