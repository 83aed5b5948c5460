"""Queries of tick bars, as-of joins, weights, regimes and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import asof, ml, regime, weights
from tickloom.operators import indicators as ind
from tickloom.operators.tickbars import tick_bars
from tickloom.plans import sql as q
from tickloom.plans.label_queries import VB, _close_trades, _rets, _sr_events, T
from tickloom.plans.queries import daily, hourly, r, register, table, ticks
from tickloom.sources import bars as src

# tick bars
_BAR = ["symbol", "candle_id", "open", "high", "low", "close", "buy_volume", "sell_volume", "volume", "n_ticks", "direction", "duration_s"]


def _recurrence(update: str, fires: str, side: str, rest: str, size: str) -> str:
    """Oracle: state (b, s) along the ticks of a symbol."""
    return f"""WITH RECURSIVE {q.TICKS}, tk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS i, CASE WHEN is_buyer_maker THEN 0 ELSE {size} END AS buy, CASE WHEN is_buyer_maker THEN {size} ELSE 0 END AS sell FROM ticks),
st AS (
  SELECT symbol, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS s, CAST(0 AS BIGINT) AS next_id, CAST(0 AS BIGINT) AS candle_id, 0 AS way FROM tk WHERE i = 1
  UNION ALL
  SELECT symbol, i, {rest}, CASE WHEN {fires} THEN id + 1 ELSE id END, id, CASE WHEN {fires} THEN {side} ELSE 0 END
  FROM (SELECT t.symbol, t.i, {update}, st.next_id AS id FROM st JOIN tk t ON t.symbol = st.symbol AND t.i = st.i + 1))
SELECT symbol, candle_id, round(min_by(price, i), 4) AS open, round(max(price), 4) AS high, round(min(price), 4) AS low, round(max_by(price, i), 4) AS close, round(sum(buy), 4) + 0.0 AS buy_volume, round(sum(sell), 4) + 0.0 AS sell_volume, round(sum(buy) + sum(sell), 4) + 0.0 AS volume,
  count(*) AS n_ticks, CAST(sum(way) AS BIGINT) AS direction, round(date_diff('microsecond', min(ts), max(ts)) / 1e6, 4) + 0.0 AS duration_s FROM tk JOIN st USING (symbol, i) GROUP BY 1, 2"""


def _ticks(name: str, method: str, threshold: float, side: str, carry: bool = False, by_value: bool = False, rows: int | None = None) -> None:
    def run(s, d):
        b = tick_bars(ticks(s, d), method, threshold, side, carry, by_value, rows)
        return b.select("symbol", "candle_id", *[r(c) for c in _BAR[2:9]], "n_ticks", "direction", r("duration_s"))

    size, t = ("price * qty" if by_value else "qty"), f"{threshold}::DOUBLE"
    if method == "volume":
        fires = {"buy": f"b1 >= {t}", "sell": f"s1 >= {t}", "either": f"b1 + s1 >= {t}"}[side]
        way = {"buy": "1", "sell": "-1", "either": "CASE WHEN b1 >= s1 THEN 1 ELSE -1 END"}[side]
        rest = f"CASE WHEN {fires} THEN CASE WHEN ({way}) = 1 THEN b1 - {t} ELSE b1 END ELSE b1 END, CASE WHEN {fires} THEN CASE WHEN ({way}) = -1 THEN s1 - {t} ELSE s1 END ELSE s1 END" if carry else f"CASE WHEN {fires} THEN 0 ELSE b1 END, CASE WHEN {fires} THEN 0 ELSE s1 END"
        update = "st.b + t.buy AS b1, st.s + t.sell AS s1"
    else:
        fires = {"abs": f"abs(b1) >= {t}", "pos": f"b1 >= {t}", "neg": f"-b1 >= {t}"}[side]
        way = "CASE WHEN b1 > 0 THEN 1 ELSE -1 END"
        rest = (f"CASE WHEN {fires} THEN b1 - ({way}) * {t} ELSE b1 END" if carry else f"CASE WHEN {fires} THEN 0 ELSE b1 END") + ", CAST(0 AS DOUBLE)"
        update = "st.b + (t.buy - t.sell) AS b1"
    register(name, run, _recurrence(update, fires, way, rest, size))


for side in ("either", "buy", "sell"):
    _ticks(f"tick_bars_volume_{side}", "volume", 5000.0, side)
for side in ("abs", "pos", "neg"):
    _ticks(f"tick_bars_netflow_{side}", "netflow", 400.0, side)
_ticks("tick_bars_volume_pieces", "volume", 5000.0, "either", rows=500)
_ticks("tick_bars_netflow_pieces", "netflow", 400.0, "abs", rows=500)
_ticks("tick_bars_carry_over", "volume", 5000.0, "either", True)
_ticks("tick_bars_dollar", "volume", 250000.0, "either", False, True)

# as-of joins


def _with_daily(s, d):
    """Hourly bars with the last finished day's mean close (shifted by one day)."""
    h = hourly(s, d)
    day = src.resample(h, F.date_trunc("day", "open_time"))
    slow = ind.sma(day, 3).withColumn("sma_3_1d", F.lag("sma_3").over(src.Window.partitionBy("symbol").orderBy("bar_id"))).where("sma_3_1d IS NOT NULL")
    return h, slow.select("symbol", "open_time", "sma_3_1d")


_DAY = f"{q.HOURLY}, dy AS (SELECT symbol, CAST(date_trunc('day', open_time) AS TIMESTAMP) AS open_time, max_by(close, bar_id) AS close FROM hourly GROUP BY 1, 2), sm AS (SELECT symbol, open_time, avg(close) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS sma_3 FROM dy), sh AS (SELECT symbol, open_time, lag(sma_3) OVER (PARTITION BY symbol ORDER BY open_time) AS sma_3_1d FROM sm), sl AS (SELECT * FROM sh WHERE sma_3_1d IS NOT NULL)"


def _aligned(direction: str, bucket=None):
    def run(s, d):
        h, slow = _with_daily(s, d)
        return asof.asof(h.select("symbol", "bar_id", "open_time", "close"), slow, "open_time", "sma_3_1d", direction=direction, bucket=bucket).select("symbol", "bar_id", r("close"), r("sma_3_1d"))

    return run


_ASOF = lambda cmp: f"WITH {_DAY} SELECT h.symbol, h.bar_id, round(h.close, 4) AS close, round(sl.sma_3_1d, 4) AS sma_3_1d FROM hourly h ASOF LEFT JOIN sl ON h.symbol = sl.symbol AND h.open_time {cmp} sl.open_time"
register("htf_align", _aligned("backward"), _ASOF(">="))
register("asof_forward", _aligned("forward"), _ASOF("<="))
# a window holds one week of a symbol
register("htf_align_pieces", _aligned("backward", lambda t: F.date_trunc("week", t)), _ASOF(">="))
register("asof_forward_pieces", _aligned("forward", lambda t: F.date_trunc("week", t)), _ASOF("<="))

# weights
_CO = f"{VB}, co AS (SELECT b.symbol, b.bar_id, b.close, (SELECT count(*) FROM vb v WHERE v.symbol = b.symbol AND b.bar_id BETWEEN v.bar_id AND v.t1) AS n_events, abs(ln(b.close) - ln(lag(b.close) OVER (PARTITION BY b.symbol ORDER BY b.bar_id))) AS move FROM bars b)"
_UQ = f"{_CO}, uq AS (SELECT v.symbol, v.bar_id, v.t1, avg(1 / greatest(n_events, 1)) AS uniqueness, coalesce(sum(move / nullif(n_events, 0)), 0) AS w0 FROM vb v JOIN co ON co.symbol = v.symbol AND co.bar_id BETWEEN v.bar_id AND v.t1 GROUP BY ALL), rw AS (SELECT *, w0 * count(*) OVER (PARTITION BY symbol) / sum(w0) OVER (PARTITION BY symbol) AS w_return FROM uq), tm AS (SELECT *, sum(uniqueness) OVER (PARTITION BY symbol ORDER BY bar_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, sum(uniqueness) OVER (PARTITION BY symbol) AS total FROM rw), tw AS (SELECT *, greatest(0, 1 - 0.5 / total * total + 0.5 / total * c) AS w_time FROM tm)"


def _weighted(build):
    def run(s, d):
        b, e = _sr_events(s, d)
        return build(e.select("symbol", "bar_id", "t1"), b)

    return run


register("w_coevents", _weighted(lambda e, b: weights.co_events(e, b).select("symbol", "bar_id", "n_events")), f"WITH {q.BARS}, {_CO} SELECT symbol, bar_id, n_events FROM co")
register("w_uniqueness", _weighted(lambda e, b: weights.uniqueness(e, b).select("symbol", "bar_id", r("uniqueness", 6))), f"WITH {q.BARS}, {_UQ} SELECT symbol, bar_id, round(uniqueness, 6) AS uniqueness FROM tw")
register("w_return", _weighted(lambda e, b: weights.return_weights(e, b).select("symbol", "bar_id", r("w_return", 6))), f"WITH {q.BARS}, {_UQ} SELECT symbol, bar_id, round(w_return, 6) AS w_return FROM tw")
register("w_time", _weighted(lambda e, b: weights.time_decay(weights.uniqueness(e, b)).select("symbol", "bar_id", r("w_time", 6))), f"WITH {q.BARS}, {_UQ} SELECT symbol, bar_id, round(w_time, 6) AS w_time FROM tw")
register("w_event", _weighted(lambda e, b: weights.event_weights(e, b).select("symbol", "bar_id", r("w_event", 6))), f"WITH {q.BARS}, {_UQ} SELECT symbol, bar_id, round(uniqueness * w_return * w_time, 6) + 0.0 AS w_event FROM tw")
register(
    "close_from_trades", lambda s, d: weights.close_from_trades(_close_trades(s, d)).select("symbol", "bar_id", r(F.col("close") + 1.23e-6).alias("close")),
    f"""{T}, pt AS (SELECT symbol, bar_id, entry_price AS price, 0 AS k FROM tr UNION ALL SELECT symbol, exit_bar, exit_price, 1 FROM tr), kn AS (SELECT symbol, bar_id, max_by(price, (k, price)) AS price FROM pt WHERE price IS NOT NULL GROUP BY 1, 2),
    sp AS (SELECT *, coalesce(lead(bar_id) OVER ({q.BY}) - 1, bar_id) AS nb, lead(price) OVER ({q.BY}) AS np FROM kn), ex AS (SELECT *, unnest(range(bar_id, nb + 1)) AS spot FROM sp) SELECT symbol, spot AS bar_id, round(coalesce(price + (np - price) * (spot - bar_id) / (nb + 1 - bar_id), price) + 1.23e-6, 4) + 0.0 AS close FROM ex""",
)

# regimes, over the returns of trades
_M = "coalesce(avg(ret), 0)"
_METRICS = {
    "sharpe": f"{_M} / (coalesce(stddev_samp(ret), 0) + 1e-12)", "sortino_good": f"{_M} / (coalesce(sqrt(avg(ret * ret) FILTER (ret < 0)), 0) + 1e-12)", "sortino_bad": f"{_M} / (coalesce(sqrt(avg(ret * ret) FILTER (ret > 0)), 0) + 1e-12)",
    "edge": "avg((ret > 0)::INT) * coalesce(avg(ret) FILTER (ret > 0), 0) - (1 - avg((ret > 0)::INT)) * coalesce(avg(-ret) FILTER (ret < 0), 0)", "kelly": f"{_M} - 0.5 * coalesce(var_samp(ret), 0)",
}
register("regime_metrics", lambda s, d: regime.metrics(_rets(s, d), "symbol").select("symbol", "n", *[r(c, 6) for c in ("mean", "std", *_METRICS)]), f"{T} SELECT symbol, count(ret) AS n, round(avg(ret), 6) + 0.0 AS mean, round(coalesce(stddev_samp(ret), 0), 6) AS std, {', '.join(f'round({v}, 6) + 0.0 AS {k}' for k, v in _METRICS.items())} FROM rr GROUP BY 1")
register(
    "regime_stability", lambda s, d: regime.stability(_rets(s, d), ["symbol"], ["bar_id"]).select("symbol", "n", r("stability", 6)),
    f"""{T}, nt AS (SELECT *, ntile(5) OVER ({q.BY}) AS part FROM rr), bn AS (SELECT symbol, part, count(*) AS size, avg((ret < 0)::INT) AS f FROM nt GROUP BY 1, 2), sm AS (SELECT symbol, CAST(sum(size) AS BIGINT) AS n, sum(size * f) / sum(size) AS fm, greatest(sum(size * f * f) / sum(size) - pow(sum(size * f) / sum(size), 2), 0) AS v, count(*) FILTER (size >= 3) AS filled FROM bn GROUP BY 1)
    SELECT symbol, n, round(exp(-v / (fm * (1 - fm) + 1e-9)) * (0.5 + filled) / 6.0, 6) AS stability FROM sm""",
)


def _featured(s, d):
    """Trades with indicator values at entry."""
    feats = ind.percent_rank(ind.bollinger_width(daily(s, d)))
    return ml.features_at_entry(_rets(s, d), feats.select("symbol", "bar_id", "bb_width", "percent_rank"))


_FEATS = ["bb_width", "percent_rank"]
register("features_at_entry", lambda s, d: _featured(s, d).select("symbol", "bar_id", r("ret", 6), r("bb_width", 6), r("percent_rank", 6)), f"""{T}, bx AS (SELECT *, {q.rolling('avg', 'close', 20)} AS mid, {q.rolling('stddev_samp', 'close', 20)} AS dev, list(close) {q.rows(20)} AS held FROM bars)
SELECT rr.symbol, rr.bar_id, round(ret, 6) + 0.0 AS ret, round(4 * dev / (mid + 1e-9), 6) AS bb_width, round(CASE WHEN len(held) = 20 THEN len(list_filter(held, lambda x: x < bx.close)) / 20 END, 6) AS percent_rank FROM rr LEFT JOIN bx USING (symbol, bar_id)""")


def _thresholds(s, d):
    rows = _featured(s, d)
    return s.createDataFrame([(f, i, round(x, 6)) for f in _FEATS for i, x in enumerate(regime.thresholds(rows, f))], "feature string, i int, threshold double")


def _best(s, d):
    found = regime.best_split(_featured(s, d), _FEATS, ["bar_id", "symbol"], min_leaf=20)
    return s.createDataFrame([(found[0][0], round(found[0][1], 6), round(found[1], 6))] if found else [], "feature string, threshold double, gain double")


def _leaves(s, d):
    rows = _featured(s, d)
    return regime.leaf_report(rows, regime.fit_tree(rows, _FEATS, ["bar_id", "symbol"]))


register("regime_thresholds", _thresholds)
register("regime_best_split", _best)
register("regime_tree_leaves", _leaves)

# cross-validation and evaluation
register(
    "cv_purged", lambda s, d: ml.purged_folds(_sr_events(s, d)[1], 5, 0.01),
    f"""WITH {q.BARS}, {VB}, n AS (SELECT symbol, bar_id, row_number() OVER ({q.BY}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM vb), f AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS fold FROM n), b AS (SELECT *, fold * floor(n / 5) AS start, CASE WHEN fold = 4 THEN n ELSE (fold + 1) * floor(n / 5) END AS stop, floor(n * 0.01) AS gap FROM f)
    SELECT symbol, bar_id, fold, CASE WHEN i >= start AND i < stop THEN 'test' WHEN i < start - gap OR i >= stop + gap THEN 'train' END AS role FROM b""",
)


def _judged(s, d):
    """Labels as truth and the sign of a noisy guess, by language."""
    docs, labels = table(s, d, "documents"), table(s, d, "labels")
    return labels.join(docs.select("doc_id", "lang"), "doc_id").select("lang", F.when(F.col("quality") == 1, 1).otherwise(-1).alias("truth"), F.when((F.col("doc_id") * 7) % 10 < 6, 1).when((F.col("doc_id") * 7) % 10 < 9, -1).otherwise(0).alias("guess"))


_J = "jd AS (SELECT lang, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS truth, CASE WHEN (doc_id * 7) % 10 < 6 THEN 1 WHEN (doc_id * 7) % 10 < 9 THEN -1 ELSE 0 END AS guess FROM labels JOIN documents USING (doc_id))"
_CM = {"accuracy": "avg((truth = guess)::INT)"}
for v_, n_ in ((1, "long"), (-1, "short")):
    hit_, said_, real_ = f"count(*) FILTER (truth = {v_} AND guess = {v_})", f"count(*) FILTER (guess = {v_})", f"count(*) FILTER (truth = {v_})"
    _CM |= {f"precision_{n_}": f"coalesce({hit_} / nullif({said_}, 0), 0)", f"recall_{n_}": f"coalesce({hit_} / nullif({real_}, 0), 0)", f"f1_{n_}": f"coalesce(2 * {hit_} / nullif({said_} + {real_}, 0), 0)"}
_CLS = f"{_J}, cm AS (SELECT lang, {', '.join(f'{v} AS {k}' for k, v in _CM.items())} FROM jd GROUP BY 1)"
_LONG = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS x FROM cm" for m in _CM)
_AGG = f"{_CLS}, lg AS ({_LONG}), ag AS (SELECT metric, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, median(x) AS median FROM lg GROUP BY 1)"
register("eval_classification", lambda s, d: ml.classification(_judged(s, d), "lang").select("lang", *[r(c, 6) for c in _CM]), f"WITH {_CLS} SELECT lang, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _CM)} FROM cm")
_summary = lambda s, d: ml.aggregate_metrics(ml.classification(_judged(s, d), "lang"), list(_CM))
register("eval_aggregate", lambda s, d: _summary(s, d).select("metric", *[r(c, 6) for c in ("mean", "std", "min", "max", "median")]), f"WITH {_AGG} SELECT metric, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('mean', 'std', 'min', 'max', 'median'))} FROM ag")
register("eval_stability", lambda s, d: ml.stability_scores(_summary(s, d)).select("metric", r("cv", 6), r("stability", 6)), f"WITH {_AGG} SELECT metric, round(std / nullif(abs(mean), 0), 6) AS cv, round(1 / (1 + std / nullif(abs(mean), 0)), 6) AS stability FROM ag")
register("ml_decisions", lambda s, d: _rets(s, d).select("symbol", "bar_id", ml.decide(F.col("ret"), 0.1, 0.2).alias("decision")), f"{T} SELECT symbol, bar_id, CASE WHEN abs(ret) < 0.2 THEN 0 WHEN ret > 0.1 THEN 1 WHEN ret < -0.1 THEN -1 ELSE 0 END AS decision FROM rr")


def _on_grid(s, d):
    b, e = _sr_events(s, d)
    ends = b.select("symbol", F.col("bar_id").alias("t1"), F.col("open_time").alias("end_time"))
    return weights.co_events_on_grid(e.select("symbol", "open_time", "t1").join(ends, ["symbol", "t1"]), 7 * 86_400)


register(
    "w_co_events_grid", _on_grid,
    f"""WITH {q.BARS}, {VB}, iv AS (SELECT v.symbol, s.open_time AS t0, b.open_time AS t1 FROM vb v JOIN bars s ON s.symbol = v.symbol AND s.bar_id = v.bar_id JOIN bars b ON b.symbol = v.symbol AND b.bar_id = v.t1), sp AS (SELECT symbol, min(t0) AS lo, max(t1) AS hi FROM iv GROUP BY 1),
    gr AS (SELECT symbol, unnest(range(lo, hi + INTERVAL 1 SECOND, INTERVAL 7 DAY)) AS at FROM sp) SELECT gr.symbol, gr.at, count(t0) AS n_events FROM gr LEFT JOIN iv ON iv.symbol = gr.symbol AND gr.at BETWEEN t0 AND t1 GROUP BY ALL""",
)
register(
    "split_symbol", lambda s, d: ml.split_samples(_rets(s, d).withColumn("sample_id", F.concat_ws("-", "symbol", F.floor(F.col("bar_id") / 50).cast("string"))), "symbol"),
    f"""{T}, u AS (SELECT DISTINCT symbol, symbol || '-' || CAST(floor(bar_id / 50) AS BIGINT) AS sample_id FROM rr), a AS (SELECT sample_id, (row_number() OVER (PARTITION BY symbol ORDER BY md5('42:' || sample_id), sample_id) - 1) / count(*) OVER (PARTITION BY symbol) AS x FROM u)
    SELECT sample_id, CASE WHEN x < 0.6::DOUBLE THEN 'train' WHEN x < 0.6::DOUBLE + 0.2::DOUBLE THEN 'val' ELSE 'test' END AS split FROM a""",
)
register("split_time", lambda s, d: ml.split_samples(_rets(s, d).withColumnRenamed("symbol", "sample_id")), f"{T}, u AS (SELECT DISTINCT symbol AS sample_id FROM rr), a AS (SELECT sample_id, (row_number() OVER (ORDER BY sample_id) - 1) / count(*) OVER () AS x FROM u) SELECT sample_id, CASE WHEN x < 0.6 THEN 'train' WHEN x < 0.8 THEN 'val' ELSE 'test' END AS split FROM a")
register("split_random", lambda s, d: ml.split_samples(_rets(s, d).withColumnRenamed("symbol", "sample_id"), "random"))


def _forest(s, d):
    rows = _featured(s, d).where("bb_width IS NOT NULL AND percent_rank IS NOT NULL").select("symbol", "bar_id", "bin", *_FEATS)
    model = ml.forest(_FEATS, trees=20, depth=5).fit(rows)
    return ml.predict(model, rows).select("symbol", "bar_id", "bin", "predicted", "confidence")


def _impurity(s, d):
    rows = _featured(s, d).where("bb_width IS NOT NULL AND percent_rank IS NOT NULL").select("bin", *_FEATS)
    return s.createDataFrame(list(ml.importances(ml.forest(_FEATS, trees=20, depth=5).fit(rows)).items()), "feature string, importance double")


register("ml_rf_predict", _forest)
register("fi_mdi", _impurity)
