"""Queries of training, importances, predictions as trades, regime rules, files and extension points."""

from __future__ import annotations

import copy

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import events as ev
from tickloom.operators import extend, ml, mlperf, regime, training
from tickloom.operators import filters as flt
from tickloom.operators import indicators as ind
from tickloom.plans import sql as q
from tickloom.plans.label_queries import PY, T, _sr_events, _trail
from tickloom.plans.more_queries import _DAY, _FEATS, _featured, _with_daily
from tickloom.plans.queries import BB, CATALOG, ORACLES, catalog, daily, on_bars, r, register, table
from tickloom.sources import bars as src

# predictions to trades: a guess from two features, and one from the width of bands alone
_FX = f"""{T}, bx AS (SELECT *, {q.rolling('avg', 'close', 20)} AS mid, {q.rolling('stddev_samp', 'close', 20)} AS dev, list(close) {q.rows(20)} AS held FROM bars),
fx AS (SELECT rr.symbol AS sample_id, rr.bar_id, rr.bin, rr.ret, rr.entry_price, rr.exit_price, 4 * dev / (mid + 1e-9) AS bb_width, CASE WHEN len(held) = 20 THEN len(list_filter(held, lambda x: x < bx.close)) / 20 END AS percent_rank FROM rr LEFT JOIN bx USING (symbol, bar_id)),
pr AS (SELECT *, percent_rank - 0.5 AS guess, bb_width - 1 AS other FROM fx)"""


def _guessed(s, d):
    rows = _featured(s, d).withColumnRenamed("symbol", "sample_id")
    return rows.withColumns({"guess": F.col("percent_rank") - 0.5, "other": F.col("bb_width") - 1})


def _taken(guess: str = "guess", threshold: float = 0.1, least: float = 0.2) -> str:
    side = f"CASE WHEN abs({guess}) < {least} THEN 0 WHEN {guess} > {threshold} THEN 1 WHEN {guess} < -{threshold} THEN -1 ELSE 0 END"
    return f"SELECT sample_id, bar_id AS entry_time, direction, entry_price, exit_price, (exit_price - entry_price) / nullif(entry_price, 0) * direction AS ret FROM (SELECT *, {side} AS direction FROM pr WHERE {guess} IS NOT NULL) WHERE direction <> 0"


def _trades(s, d, guess: str = "guess"):
    return mlperf.prediction_trades(_guessed(s, d), guess, 0.1, 0.2)


register("ml_trades", lambda s, d: _trades(s, d).select("sample_id", "entry_time", "direction", r("ret", 6)), f"{_FX} SELECT sample_id, entry_time, direction, round(ret, 6) + 0.0 AS ret FROM ({_taken()})")
_TM = "sum(ret) AS total_return, avg(ret) AS mean_return, stddev_pop(ret) AS return_std, avg(ret) * 252 / (stddev_samp(ret) * sqrt(252)) AS sharpe, avg((ret > 0)::INT) AS win_rate, count(ret) AS n_trades"
_TMC = ["total_return", "mean_return", "return_std", "sharpe", "win_rate", "max_drawdown"]
register(
    "ml_trading_metrics", lambda s, d: mlperf.trading_metrics(_trades(s, d)).select("sample_id", "n_trades", *[r(c, 6) for c in _TMC]),
    f"""{_FX}, tk AS ({_taken()}), eq AS (SELECT *, product(1 + coalesce(ret, 0)) OVER w AS equity FROM tk WINDOW w AS (PARTITION BY sample_id ORDER BY entry_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    dd AS (SELECT sample_id, min(equity / peak - 1) AS max_drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY sample_id ORDER BY entry_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM eq) GROUP BY 1),
    m AS (SELECT sample_id, {_TM} FROM tk GROUP BY 1) SELECT sample_id, n_trades, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _TMC)} FROM m JOIN dd USING (sample_id)""",
)
_BASIC = "count(ret) AS n_trades, 100 * avg((ret > 0)::INT) AS win_rate, CASE WHEN coalesce(sum(-ret) FILTER (ret < 0), 0) > 0 THEN coalesce(sum(ret) FILTER (ret > 0), 0) / sum(-ret) FILTER (ret < 0) WHEN sum(ret) FILTER (ret > 0) > 0 THEN CAST('inf' AS DOUBLE) END AS profit_factor, avg(ret) * 365 / (stddev_samp(ret) * sqrt(365)) AS sharpe, avg(ret) * 365 AS annual_return, stddev_samp(ret) * sqrt(365) AS annual_volatility, coalesce(min(ret) FILTER (ret < 0), 0) AS max_loss"
_performance = lambda s, d, guess="guess": mlperf.strategy_performance(_trades(s, d, guess), PY)
register("ml_performance", lambda s, d: _performance(s, d).select("sample_id", *[r(F.col(c).cast("double"), 6).alias(c) for c in mlperf.MEASURES]), f"{_FX}, m AS (SELECT sample_id, {_BASIC} FROM ({_taken()}) GROUP BY 1) SELECT sample_id, {', '.join(f'round({c}::DOUBLE, 6) + 0.0 AS {c}' for c in mlperf.MEASURES)} FROM m")
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS metric, {c}::DOUBLE AS x FROM m" for c in mlperf.MEASURES)
register("ml_overall", lambda s, d: mlperf.overall(_performance(s, d)).select("metric", *[r(c, 5) for c in ("mean", "std", "min", "max", "median")]), f"{_FX}, m AS (SELECT sample_id, {_BASIC} FROM ({_taken()}) GROUP BY 1), lg AS ({_LONG}) SELECT metric, round(avg(x), 5) + 0.0 AS mean, round(stddev_pop(x), 5) + 0.0 AS std, round(min(x), 5) + 0.0 AS min, round(max(x), 5) + 0.0 AS max, round(median(x), 5) + 0.0 AS median FROM lg GROUP BY 1")
_compared = lambda s, d: mlperf.compare_models({"ranks": _performance(s, d), "widths": _performance(s, d, "other")})
_CMP = f"{_FX}, m0 AS (SELECT 'ranks' AS model_name, sample_id, {_BASIC} FROM ({_taken()}) GROUP BY ALL), m1 AS (SELECT 'widths' AS model_name, sample_id, {_BASIC} FROM ({_taken('other')}) GROUP BY ALL), cp AS (SELECT model_name, {', '.join(f'avg({c}) AS {c}_mean' for c in mlperf.MEASURES)} FROM (FROM m0 UNION ALL FROM m1) GROUP BY 1)"
register("ml_compare", lambda s, d: _compared(s, d).select("model_name", *[r(f"{c}_mean", 5) for c in mlperf.MEASURES]), f"{_CMP} SELECT model_name, {', '.join(f'round({c}_mean, 5) + 0.0 AS {c}_mean' for c in mlperf.MEASURES)} FROM cp")
register("ml_best_model", lambda s, d: mlperf.best_model(_compared(s, d), "sharpe_mean").select("model_name", r("sharpe_mean", 5)), f"{_CMP} SELECT min_by(model_name, (-sharpe_mean, model_name)) AS model_name, round(max(sharpe_mean), 5) + 0.0 AS sharpe_mean FROM cp")


def _folded(s, d):
    trades = _trades(s, d)
    folds = ml.purged_folds(trades, 4, 0.0, "sample_id", "entry_time").where("role = 'test'").select("sample_id", "entry_time", "fold")
    return mlperf.fold_performance(trades, folds, PY).select("fold", "n_trades", r("win_rate", 6), r("sharpe", 6))


register("ml_fold_performance", _folded, f"{_FX}, tk AS ({_taken()}), nb AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY entry_time) - 1 AS i, count(*) OVER (PARTITION BY sample_id) AS n FROM tk), fd AS (SELECT *, CAST(least(CASE WHEN n < 4 THEN 3 ELSE floor(i / floor(n / 4)) END, 3) AS INT) AS fold FROM nb) SELECT fold, count(ret) AS n_trades, round(100 * avg((ret > 0)::INT), 6) + 0.0 AS win_rate, round(avg(ret) * 365 / (stddev_samp(ret) * sqrt(365)), 6) + 0.0 AS sharpe FROM fd GROUP BY 1")
_PAIRS = ["win_rate", "sharpe", "annual_return"]
register(
    "ml_metric_correlation", lambda s, d: mlperf.metric_correlation(_performance(s, d), _PAIRS).select(r("correlation_mean", 6), r("correlation_std", 6)),
    f"""{_FX}, m AS (SELECT sample_id, {_BASIC} FROM ({_taken()}) GROUP BY 1), rk AS (SELECT {', '.join(f'rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}' for c in _PAIRS)} FROM m),
    cs AS (SELECT corr(sharpe, win_rate) AS c FROM rk UNION ALL SELECT corr(annual_return, win_rate) FROM rk UNION ALL SELECT corr(annual_return, sharpe) FROM rk) SELECT round(avg(c), 6) + 0.0 AS correlation_mean, round(stddev_pop(c), 6) + 0.0 AS correlation_std FROM cs""",
)
register("ml_sample_summary", lambda s, d: training.sample_summary(_guessed(s, d)).select("sample_id", "n_rows"), f"{_FX} SELECT sample_id, count(*) AS n_rows FROM fx GROUP BY 1")


# orthogonal features: standardised values, and the basis in the order of the features
def _orthogonal(s, d):
    rows = _featured(s, d).dropna(subset=_FEATS).select("symbol", "bar_id", *_FEATS)
    return training.orthogonal(rows, _FEATS).transform(rows).select("symbol", "bar_id", r("orth_0", 6), r("orth_1", 6))


register("ml_standardized", lambda s, d: training.orthogonal(x := _featured(s, d).dropna(subset=_FEATS), _FEATS).standardized(x).select("symbol", "bar_id", *[r(f, 6) for f in _FEATS]), f"{_FX}, z AS (SELECT * FROM fx WHERE bb_width IS NOT NULL AND percent_rank IS NOT NULL) SELECT sample_id AS symbol, bar_id, {', '.join(f'round(({f} - avg({f}) OVER ()) / stddev_samp({f}) OVER (), 6) + 0.0 AS {f}' for f in _FEATS)} FROM z")
register(
    "ml_orthogonal", _orthogonal,
    f"""{_FX}, z AS (SELECT sample_id AS symbol, bar_id, {', '.join(f'({f} - avg({f}) OVER ()) / stddev_samp({f}) OVER () AS {f}' for f in _FEATS)} FROM fx WHERE bb_width IS NOT NULL AND percent_rank IS NOT NULL),
    a AS (SELECT *, bb_width / sqrt(sum(bb_width * bb_width) OVER ()) AS o0 FROM z), b AS (SELECT *, percent_rank - o0 * sum(o0 * percent_rank) OVER () AS rest FROM a)
    SELECT symbol, bar_id, round(o0, 6) + 0.0 AS orth_0, round(rest / sqrt(sum(rest * rest) OVER ()), 6) + 0.0 AS orth_1 FROM b""",
)

# models: no SQL for forests; held against the library's own parts in tests
_small = lambda f: ml.forest(f, trees=5, depth=4)


def _learned(s, d):
    return _featured(s, d).dropna(subset=_FEATS).select(F.col("symbol").alias("sample_id"), "bar_id", "bin", *_FEATS)


def _voted(kind: str):
    def run(s, d):
        rows = _learned(s, d)
        samples = sorted(x[0] for x in rows.select("sample_id").distinct().collect())
        models = training.train_ensemble(rows, _FEATS, samples, kind, fit=_small, **({"n_models": 3} if kind == "bagging" else {}))
        return training.predict_voting(models, rows).select("sample_id", "bar_id", "bin", r("predicted", 6))

    return run


register("ml_voting", _voted("voting"))
register("ml_bagging", _voted("bagging"))


def _importances(s, d):
    rows = _featured(s, d).dropna(subset=_FEATS).select("symbol", "bar_id", "bin", *_FEATS)
    return training.feature_importance(rows, _FEATS, methods=training.METHODS, folds=2, fit=_small)


register("fi_all_methods", _importances)
register("fi_top_features", lambda s, d: training.top_features(_importances(s, d), 1))
# a table of importances: each priority's share of the value of the orders of a status
def _scores(s, d):
    value = F.sum("o_totalprice")
    each = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("feature"), F.col("o_orderstatus").alias("method")).agg(value.alias("value"))
    return each.select("feature", "method", (F.col("value") / F.sum("value").over(Window.partitionBy("method"))).alias("importance"))


_S = "WITH vs AS (SELECT o_orderpriority AS feature, o_orderstatus AS method, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2), sc AS (SELECT feature, method, value / sum(value) OVER (PARTITION BY method) AS importance FROM vs), mn AS (SELECT feature, avg(importance) AS importance FROM sc GROUP BY 1)"
register("fi_mean_top", lambda s, d: training.top_features(_scores(s, d), 2).select("feature", r("importance", 6)), f"{_S} SELECT feature, round(importance, 6) AS importance FROM mn ORDER BY importance DESC, feature LIMIT 2")
register("fi_filter", lambda s, d: training.important(_scores(s, d), 0.2).select("feature", r("importance", 6)), f"{_S} SELECT feature, round(importance, 6) AS importance FROM mn WHERE importance > 0.2")
register("fi_compare_methods", lambda s, d: training.compare_methods(_scores(s, d)).select("feature", "method", "rank", r("mean_rank", 6)), f"{_S} SELECT feature, method, CAST(rank AS INT) AS rank, round(avg(rank) OVER (PARTITION BY feature), 6) AS mean_rank FROM (SELECT *, rank() OVER (PARTITION BY method ORDER BY importance DESC) AS rank FROM sc)")

# regimes with categories and rules
_ORDER = ["bar_id", "symbol"]


def _grouped(s, d):
    return _featured(s, d).withColumn("weekday", F.date_format("open_time", "E"))


def _report(s, d, mode: str = "good"):
    rows = _grouped(s, d)
    tree = regime.fit_tree(rows, ["weekday", "bb_width"], _ORDER, mode=mode, max_depth=1, categories=["weekday"])
    return rows, tree, regime.leaf_report(rows, tree, order=_ORDER, mode=mode)


register("regime_categories", lambda s, d: _report(s, d)[2].select("leaf_id", "rule", "depth", "n", r("leaf_score", 6)))
register("regime_rules_json", lambda s, d: regime.rules_json((x := _report(s, d, "bad"))[2], x[1]))
register("regime_assign", lambda s, d: regime.members((x := _report(s, d))[0], x[1], ["symbol", "bar_id"]))
# a tree with given rules, which SQL can follow too
_TREE = regime.Node(0, 0, split=("percent_rank", 0.5), gain=2.0)
_TREE.left = regime.Node(1, 1, [("percent_rank", "<=", 0.5)])
_TREE.right = regime.Node(2, 1, [("percent_rank", ">", 0.5)], ("symbol", ("1-URGENT", "2-HIGH")), 1.0)
_TREE.right.left = regime.Node(3, 2, [*_TREE.right.rule, ("symbol", "in", ("1-URGENT", "2-HIGH"))])
_TREE.right.right = regime.Node(4, 2, [*_TREE.right.rule, ("symbol", "not in", ("1-URGENT", "2-HIGH"))])
_LEAF = "CASE WHEN coalesce(percent_rank <= 0.5, false) THEN 1 WHEN sample_id IN ('1-URGENT', '2-HIGH') THEN 3 ELSE 4 END"
register("regime_given_rules", lambda s, d: regime.members(_featured(s, d), _TREE, ["symbol", "bar_id"]), f"{_FX} SELECT sample_id AS symbol, bar_id, {_LEAF} AS leaf_id FROM fx")
register(
    "regime_leaf_report", lambda s, d: regime.leaf_report(_featured(s, d), _TREE, order=_ORDER).select("leaf_id", "n", "depth", r("perf_value", 6), r("stability", 6), r("leaf_score", 6)),
    f"""{_FX}, lf AS (SELECT *, {_LEAF} AS leaf_id FROM fx), nt AS (SELECT *, ntile(5) OVER (PARTITION BY leaf_id ORDER BY bar_id, sample_id) AS part FROM lf), bn AS (SELECT leaf_id, part, count(*) AS size, avg((ret < 0)::INT) AS f FROM nt GROUP BY 1, 2),
    sm AS (SELECT leaf_id, sum(size * f) / sum(size) AS fm, greatest(sum(size * f * f) / sum(size) - pow(sum(size * f) / sum(size), 2), 0) AS v, count(*) FILTER (size >= 3) AS filled FROM bn GROUP BY 1), st AS (SELECT leaf_id, exp(-v / (fm * (1 - fm) + 1e-9)) * (0.5 + filled) / 6.0 AS stability FROM sm),
    pf AS (SELECT leaf_id, count(ret) AS n, coalesce(avg(ret), 0) / (coalesce(stddev_samp(ret), 0) + 1e-12) AS perf_value FROM lf GROUP BY 1)
    SELECT leaf_id, n, CASE leaf_id WHEN 1 THEN 1 ELSE 2 END AS depth, round(perf_value, 6) + 0.0 AS perf_value, round(stability, 6) AS stability, round(perf_value * stability, 6) + 0.0 AS leaf_score FROM pf JOIN st USING (leaf_id)""",
)


def _weighed(s, d):
    """The tree with the squared deviations of returns that each split takes away as its gains."""
    rows = _featured(s, d).where("ret IS NOT NULL")
    spread = lambda on: F.coalesce(F.var_pop(F.when(on, F.col("ret"))) * F.count_if(on), F.lit(0.0))
    inner = [n for n in regime.walk(_TREE) if n.split]
    gains = rows.agg(*[(spread(regime.condition(n.rule)) - spread(regime.condition(n.left.rule)) - spread(regime.condition(n.right.rule))).alias(str(n.node_id)) for n in inner]).first()
    found = copy.deepcopy(_TREE)
    for n in regime.walk(found):
        if n.split:
            n.gain = gains[str(n.node_id)]
    total, used = regime.feature_importances(found), regime.split_counts(found)
    return s.createDataFrame([(f, float(x), used[f]) for f, x in total.items()], "feature string, importance double, n_splits int").select("feature", r("importance", 6), "n_splits")


_SPREAD = "coalesce(var_pop(ret) FILTER ({0}) * count(*) FILTER ({0}), 0)".format
_LEFT, _IN = "coalesce(percent_rank <= 0.5, false)", "sample_id IN ('1-URGENT', '2-HIGH')"
register(
    "regime_importances", _weighed,
    f"""{_FX}, g AS (SELECT {_SPREAD('true')} - {_SPREAD(_LEFT)} - {_SPREAD(f'NOT {_LEFT}')} AS a, ({_SPREAD(f'NOT {_LEFT}')} - {_SPREAD(f'NOT {_LEFT} AND {_IN}')} - {_SPREAD(f'NOT {_LEFT} AND NOT {_IN}')}) / 2 AS b FROM fx WHERE ret IS NOT NULL)
    SELECT feature, round(x / (a + b), 6) + 0.0 AS importance, 1 AS n_splits FROM (SELECT 'percent_rank' AS feature, a AS x, a, b FROM g UNION ALL SELECT 'symbol', b, a, b FROM g)""",
)

_LEVELS = [0.05 + 0.9 * i / 18 for i in range(19)]
_QUANTILES = " UNION ALL ".join(f"SELECT '{f}' AS feature, unnest(list_distinct(quantile_cont({f}, {_LEVELS}))) AS threshold FROM fx" for f in _FEATS)
ORACLES["regime_thresholds"] = f"{_FX}, qs AS ({_QUANTILES}) SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY threshold) - 1 AS INT) AS i, round(threshold, 6) + 0.0 AS threshold FROM qs"

# both sides of every threshold, and all rows as the parent: Sharpe ratio times evenness of losses over five bins
_SIDES = f"""{_FX}, qs AS ({_QUANTILES}), sd AS (SELECT feature, threshold, coalesce(CASE feature WHEN 'bb_width' THEN bb_width ELSE percent_rank END <= threshold, false) AS low, ret, bar_id, sample_id FROM fx, qs UNION ALL SELECT 'all', 0, true, ret, bar_id, sample_id FROM fx),
nt AS (SELECT *, ntile(5) OVER (PARTITION BY feature, threshold, low ORDER BY bar_id, sample_id) AS part FROM sd),
bn AS (SELECT feature, threshold, low, part, count(*) AS size, avg((ret < 0)::INT) AS f FROM nt GROUP BY ALL),
sm AS (SELECT feature, threshold, low, sum(size) AS n, sum(size * f) / sum(size) AS fm, greatest(sum(size * f * f) / sum(size) - pow(sum(size * f) / sum(size), 2), 0) AS v, count(*) FILTER (size >= 3) AS filled FROM bn GROUP BY ALL),
pf AS (SELECT feature, threshold, low, coalesce(avg(ret), 0) / (coalesce(stddev_samp(ret), 0) + 1e-12) AS perf FROM sd GROUP BY ALL),
sc AS (SELECT feature, threshold, low, n, perf * exp(-v / (fm * (1 - fm) + 1e-9)) * (0.5 + filled) / 6.0 AS score FROM sm JOIN pf USING (feature, threshold, low)),
gn AS (SELECT feature, threshold, max(score) - (SELECT score FROM sc WHERE feature = 'all') AS gain FROM sc WHERE feature <> 'all' GROUP BY ALL HAVING count(*) = 2 AND min(n) >= 20)"""
ORACLES["regime_best_split"] = f"{_SIDES} SELECT feature, round(threshold, 6) + 0.0 AS threshold, round(gain, 6) + 0.0 AS gain FROM gn WHERE gain > 0 ORDER BY round(gn.gain, 10) DESC, feature, gn.threshold LIMIT 1"

# catalog, thresholds over time, managers and charts
register("symbols_listed", lambda s, d: src.keep_listed(s.sql("SELECT * FROM VALUES ('NATION_7', 1), ('ATLANTIS', 2), ('NATION_3', 3) AS t(symbol, place)"), catalog(s, d)), f"WITH {CATALOG}, w AS (SELECT * FROM (VALUES ('NATION_7', 1), ('ATLANTIS', 2), ('NATION_3', 3)) t(symbol, place)) SELECT * FROM w WHERE symbol IN (SELECT symbol FROM catalog)")
register("symbols_trading", lambda s, d: src.trading(catalog(s, d).withColumn("status", F.when(F.length("symbol") % 2 == 0, "trading").otherwise("HALT")).withColumn("symbol", F.lower("symbol"))).select("symbol", "quote_asset"), f"WITH {CATALOG} SELECT symbol, quote_asset FROM catalog WHERE length(symbol) % 2 = 0")
register(
    "ev_cusum_by_table", lambda s, d: ev.cusum_by_table(b := daily(s, d), b.where("bar_id % 50 = 10").select("symbol", "open_time", F.col("close").alias("threshold"))).select("symbol", "bar_id", F.col("direction").cast("int").alias("direction")),
    f"""WITH RECURSIVE {q.BARS}, th AS (SELECT *, last_value(CASE WHEN bar_id % 50 = 10 THEN close END IGNORE NULLS) OVER ({q.BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lim FROM bars), c AS (
  SELECT symbol, bar_id, close, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS dn, 0 AS direction FROM th WHERE bar_id = 1
  UNION ALL
  SELECT symbol, bar_id, close, CASE WHEN NOT fall AND rise THEN 0 ELSE u END, CASE WHEN fall THEN 0 ELSE d END, CASE WHEN fall THEN -1 WHEN rise THEN 1 ELSE 0 END
  FROM (SELECT *, coalesce(d < -lim, false) AS fall, coalesce(u > lim, false) AS rise FROM (SELECT b.symbol, b.bar_id, b.close, b.lim, greatest(0, c.up + b.close - c.close) AS u, least(0, c.dn + b.close - c.close) AS d FROM c JOIN th b ON b.symbol = c.symbol AND b.bar_id = c.bar_id + 1)))
SELECT symbol, bar_id, direction FROM c WHERE direction <> 0""",
)
_manager = lambda independent: extend.IndicatorManager(independent).add(ind.sma).add(lambda b: ind.bollinger(b, 20, 2.0))
for kind_, flag_ in (("sequential", False), ("independent", True)):
    on_bars(f"ind_manager_{kind_}", {"sma_20": 4, "bb_middle": 4, "bb_upper": 4}, lambda b, flag_=flag_: _manager(flag_).calculate(b, append=False), f"{BB}, o AS (SELECT *, avg(close) {q.rows(20)} AS sma_20 FROM b2)")


def _higher(s, d):
    h, _ = _with_daily(s, d)
    day = src.resample(h, F.date_trunc("day", "open_time"))
    own = extend.HigherTimeframeManager().add(lambda b: ind.sma(b, 5)).add_higher(lambda b: ind.sma(b, 3), ["sma_3"], "1d")
    return own.calculate(h, coarse=day).select("symbol", "bar_id", r("sma_5"), r("sma_3_1d"))


register("ind_manager_higher", _higher, f"WITH {_DAY}, sf AS (SELECT *, avg(close) {q.rows(5)} AS sma_5 FROM hourly) SELECT h.symbol, h.bar_id, round(h.sma_5, 4) + 0.0 AS sma_5, round(sl.sma_3_1d, 4) + 0.0 AS sma_3_1d FROM sf h ASOF LEFT JOIN sl ON h.symbol = sl.symbol AND h.open_time >= sl.open_time")
register(
    "plot_frame", lambda s, d: extend.plot_frame(b := daily(s, d), ev.zscore(b).withColumn("open_time", F.col("open_time") - F.expr("INTERVAL 1 HOUR"))).select("symbol", "bar_id", "rising", F.col("signal").cast("int").alias("signal"), r("signal_price")),
    f"""WITH {q.BARS}, {BB}, x AS (SELECT *, CASE WHEN (close - bb_middle) / nullif((bb_upper - bb_middle) / 2, 0) < -2 THEN 1 WHEN (close - bb_middle) / nullif((bb_upper - bb_middle) / 2, 0) > 2 THEN -1 END AS side FROM b2)
    SELECT symbol, bar_id, close >= open AS rising, side AS signal, CASE WHEN side IS NOT NULL THEN round(close, 4) + 0.0 END AS signal_price FROM x""",
)

# filters of further kinds: held against brute force in tests
on_bars("flt_butter_band", {"butter": 3}, lambda b: flt.butterworth(b, cutoff=(0.05, 0.3), kind="band"), None)
on_bars("flt_wavelet_db8_hard", {"wavelet": 3}, lambda b: flt.wavelet(b, family=8, mode="hard"), None)
on_bars("flt_emd", {"emd": 3}, lambda b: flt.empirical_filter(b, [1]), None)
