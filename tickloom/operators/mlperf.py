"""From predictions to trades, their performance, and models compared by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import ml, performance


def prediction_trades(rows: DataFrame, prediction: str = "predicted", threshold: float = 0.0, least: float = 0.0, entry: str = "entry_price", exit_: str = "exit_price", time: str = "bar_id", by: str = "sample_id") -> DataFrame:
    """Trades of the rows whose prediction leads to a decision (see ``ml.decide``).

    A trade enters and leaves at the prices of its row; its exit time is its entry time.
    Columns: sample_id (or other group), entry_time, exit_time, direction, bin, entry_price, exit_price, ret.
    """
    p = F.col(prediction)
    taken = rows.where(p.isNotNull()).withColumn("direction", ml.decide(p, max(threshold, 0.0), least)).where("direction <> 0")
    ret = F.try_divide(F.col(exit_) - F.col(entry), F.col(entry)) * F.col("direction")
    return taken.select(F.col(by), F.col(time).alias("entry_time"), F.col(time).alias("exit_time"), "direction", F.col("direction").alias("bin"), F.col(entry).alias("entry_price"), F.col(exit_).alias("exit_price"), ret.alias("ret"))


def trading_metrics(trades: DataFrame, by: str = "sample_id", order: str = "entry_time", per_year: float = 252.0) -> DataFrame:
    """Sum, mean and population deviation of returns, Sharpe ratio, deepest fall, share of wins and number, by sample."""
    x = F.col("ret")
    sums = trades.groupBy(by).agg(F.sum(x).alias("total_return"), F.avg(x).alias("mean_return"), F.stddev_pop(x).alias("return_std"), performance.sharpe(x, per_year).alias("sharpe"), F.avg((x > 0).cast("double")).alias("win_rate"), F.count(x).alias("n_trades"))
    falls = performance.equity(trades, by, order).groupBy(by).agg(F.min("drawdown").alias("max_drawdown"))
    return sums.join(falls, by)


def strategy_performance(trades: DataFrame, per_year: float, by: str = "sample_id") -> DataFrame:
    """Basic and detailed measures of the trades of each sample, one row per sample."""
    return performance.basic(trades, per_year, by).join(performance.detailed(trades, per_year, by), by)


#: Measures that ``overall`` and ``compare_models`` gather over samples.
MEASURES = ["n_trades", "win_rate", "profit_factor", "sharpe", "annual_return", "annual_volatility", "max_loss"]


def overall(table: DataFrame, measures: list[str] = MEASURES) -> DataFrame:
    """Mean, deviation, extremes and median of each measure over samples."""
    return ml.aggregate_metrics(table, measures)


def compare_models(tables: dict[str, DataFrame], measures: list[str] = MEASURES) -> DataFrame:
    """Mean of each measure over samples, one row per model; a table has one row per sample."""
    out = None
    for name, table in tables.items():
        one = table.agg(*[F.avg(m).alias(f"{m}_mean") for m in measures]).select(F.lit(name).alias("model_name"), "*")
        out = one if out is None else out.union(one)
    return out


def best_model(summary: DataFrame, metric: str = "accuracy_mean") -> DataFrame:
    """The model of the largest metric (the first name among equals), with that value."""
    if metric not in summary.columns:
        raise ValueError(f"no column {metric}")
    top = summary.where(F.col(metric).isNotNull()).groupBy().agg(F.min_by("model_name", F.struct(-F.col(metric), "model_name")).alias("model_name"), F.max(metric).alias(metric))
    return top.where("model_name IS NOT NULL")


def fold_performance(trades: DataFrame, folds: DataFrame, per_year: float, by: str = "fold", key: tuple[str, ...] = ("sample_id", "entry_time")) -> DataFrame:
    """Basic measures of the trades in each fold (``folds``: the key and the fold)."""
    return performance.basic(trades.join(folds, list(key)), per_year, by)


def metric_correlation(table: DataFrame, metrics: list[str], key: str = "sample_id") -> DataFrame:
    """Mean and population deviation of Spearman's correlation over all pairs of metrics.

    ``table`` has one row per sample (``key``); equal values share their mean rank.
    """
    each = table.select(F.col(key).alias("row"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])).alias("m")).select("row", "m.*")
    own = Window.partitionBy("metric")
    mid = F.rank().over(own.orderBy("x")) + (F.count("*").over(Window.partitionBy("metric", "x")) - 1) / 2
    ranks = each.withColumn("r", mid).groupBy("row").agg(*[F.max(F.when(F.col("metric") == m, F.col("r"))).alias(f"r{i}") for i, m in enumerate(metrics)])
    pairs = [(i, j) for i in range(len(metrics)) for j in range(i)]
    row = ranks.agg(*[F.corr(f"r{i}", f"r{j}").alias(f"c{i}_{j}") for i, j in pairs])
    return row.select(F.explode(F.array(*[f"c{i}_{j}" for i, j in pairs])).alias("c")).agg(F.avg("c").alias("correlation_mean"), F.stddev_pop("c").alias("correlation_std"))
