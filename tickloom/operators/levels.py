"""Level finders: volume profile and levels over several timeframes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.kernels import along_bars
from tickloom.functions.pieces import running
from tickloom.sources.bars import resample


def last_bars(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("bar_id"))
    return bars.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n).drop("_back")


def volume_profile(bars: DataFrame, lookback: int = 100, bins: int = 80, node_percentile: float = 70.0) -> DataFrame:
    """Volume by price bin over the last bars: each bar's volume in equal parts over the
    bins whose middle lies in its range. Columns: symbol, bin, price, volume, poc
    (largest), high_volume (at least the percentile of filled bins), value_area (bins in
    falling volume up to 70 percent of it)."""
    own = last_bars(bars, lookback)
    span = own.groupBy("symbol").agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.max_by("close", "bar_id").alias("last_close"))
    at = own.join(span, "symbol").withColumn("width", (F.col("hi") - F.col("lo")) / bins).where("width > 0")
    low = F.ceil((F.col("low") - F.col("lo")) / F.col("width") - 0.5)
    high = F.floor((F.col("high") - F.col("lo")) / F.col("width") - 0.5)
    each = at.withColumns({"b0": F.greatest(low, F.lit(0)), "b1": F.least(high, F.lit(bins - 1))}).where("b0 <= b1")
    each = each.withColumn("bin", F.explode(F.sequence("b0", "b1"))).withColumn("part", F.col("volume") / (F.col("b1") - F.col("b0") + 1))
    prof = each.groupBy("symbol", "bin").agg((F.first("lo") + (F.col("bin") + 0.5) * F.first("width")).alias("price"), F.sum("part").alias("volume"), F.first("last_close").alias("last_close"))
    w = Window.partitionBy("symbol")
    order = w.orderBy(F.desc("volume"), "bin")
    prof = prof.withColumns({
        "poc": F.row_number().over(order) == 1,
        "high_volume": F.col("volume") >= F.percentile("volume", F.lit(node_percentile / 100)).over(w),
        "value_area": F.sum("volume").over(order.rowsBetween(Window.unboundedPreceding, -1)).isNull() | (F.sum("volume").over(order.rowsBetween(Window.unboundedPreceding, -1)) < 0.7 * F.sum("volume").over(w)),
    })
    return prof


def profile_levels(profile: DataFrame, n: int = 3) -> DataFrame:
    """The n high-volume prices of most volume on each side of the last close."""
    side = F.when(F.col("price") < F.col("last_close"), "support").otherwise("resistance")
    w = Window.partitionBy("symbol", "side").orderBy(F.desc("volume"), "bin")
    out = profile.where("high_volume").withColumn("side", side).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return out.select("symbol", "side", "rank", "price", "volume")


def islands(points: DataFrame, by: list[str], price: str, share: float = 0.005, least: int = 2) -> DataFrame:
    """One-dimensional density clusters: points sorted by price stay together while gaps are
    at most ``share`` of the mean price; smaller groups than ``least`` (2) go."""
    own, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(price, "open_time")
    gap = F.coalesce((F.col(price) - F.lag(price).over(order) > share * F.avg(price).over(own)).cast("int"), F.lit(0))
    out = points.withColumn("_gap", gap).withColumn("cluster", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")
    return out.withColumn("_n", F.count("*").over(Window.partitionBy(*by, "cluster"))).where(F.col("_n") >= least).drop("_n")


#: Widths of reach in one piece of the price axis.
CELLS = 256


def density(points: DataFrame, by: list[str], price: str, share: float = 0.005, least: int = 3, cells: int = CELLS) -> DataFrame:
    """One-dimensional density clusters: a point with at least ``least`` points, itself included, within
    ``share`` of the mean price is a core; cores within that reach of each other are one cluster
    (``cluster``: 0, 1, ... by rising price); other points join a cluster with a core in reach, the lower
    one of two; the rest are noise and go, as do points without a price and groups whose mean price is
    not positive.

    Equal prices are counted first. The price axis falls into pieces of ``cells`` reaches with a halo
    of two, and clusters are numbered by the counts of the pieces before, so a group is many tasks.
    """
    priced = points.drop("cluster").where(F.col(price).isNotNull() & ~F.isnan(price))
    reach = priced.groupBy(*by).agg((F.avg(price) * share).alias("_reach"))
    sites = priced.groupBy(*by, price).agg(F.count("*").alias("_held")).join(reach, by).where("_reach > 0").withColumn("_u", F.col(price) / F.col("_reach"))
    at = F.col("_u")
    spread = sites.withColumn("_cell", F.explode(F.sequence(F.floor((at - 2) / cells), F.floor((at + 2) / cells))))
    up, down = (Window.partitionBy(*by, "_cell").orderBy(o) for o in (F.asc("_u"), F.desc("_u")))
    cored = spread.withColumn("_core", F.when(F.sum("_held").over(up.rangeBetween(-1, 1)) >= least, at))
    past = lambda w: F.last("_core", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    seen = cored.withColumns({"_below": past(up), "_above": past(down)}).where(F.col("_cell") == F.floor(at / cells))
    near_below, near_above = F.coalesce(at - F.col("_below") <= 1, F.lit(False)), F.coalesce(F.col("_above") - at <= 1, F.lit(False))
    seen = seen.withColumn("_begins", (F.col("_core").isNotNull() & ~near_below).cast("long"))
    numbered = running(seen, {"_begun": ("sum", "_begins")}, cells, tuple(by), "_u")
    # a point below all cores in its reach takes the cluster of the core above, which may have begun before
    new_above = F.col("_below").isNull() | (F.col("_above") - F.col("_below") > 1)
    cluster = F.when(F.col("_core").isNotNull() | near_below, F.col("_begun") - 1).when(near_above, F.col("_begun") - 1 + new_above.cast("long"))
    labels = numbered.select(*by, price, cluster.cast("long").alias("cluster")).where("cluster IS NOT NULL")
    return priced.join(labels, [*by, price]).select(*priced.columns, "cluster")


def average_range(tr: np.ndarray, n: int) -> np.ndarray:
    """Wilder's mean of true ranges; the first n values are all the mean of those n."""
    out = np.zeros(len(tr))
    out[:n] = tr[:n].mean() if len(tr) else 0.0
    for i in range(n, len(tr)):
        out[i] = (out[i - 1] * (n - 1) + tr[i]) / n
    return out


def _unbeaten(x: np.ndarray) -> np.ndarray:
    """How many values right before each one are all smaller than it."""
    out, stack = np.zeros(len(x), np.int64), []
    for i, v in enumerate(x):
        while stack and x[stack[-1]] < v:
            stack.pop()
        out[i] = i - (stack[-1] + 1 if stack else 0)
        stack.append(i)
    return out


def timeframe_pivots(bars: DataFrame, buckets: dict[str, tuple[Column, float]], factor: float = 1.0, atr: int = 14) -> DataFrame:
    """Highs and lows that strictly exceed the bars around them, in each timeframe.

    The reach on both sides follows the average range: max(2, int(range*factor/(close*0.001)))
    bars, fewer where the series ends; the two bars at each end are no pivots.
    Columns: symbol, open_time, side, timeframe, weight, price, volume.
    """

    def run(g: pd.DataFrame) -> dict[str, np.ndarray]:
        high, low, close = (g[c].to_numpy(float) for c in ("high", "low", "close"))
        n, k = len(g), np.arange(len(g))
        before = np.concatenate([g["open"].to_numpy(float)[:1], close[:-1]])
        tr = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
        reach = np.maximum(2, (average_range(tr, atr) * factor / (close * 0.001)).astype(np.int64))
        inside = (k >= 2) & (k < n - 2)
        out = {}
        for name, x in (("top", high), ("bottom", -low)):
            out[name] = (inside & (_unbeaten(x) >= np.minimum(reach, k)) & (_unbeaten(x[::-1])[::-1] >= np.minimum(reach, n - 1 - k))).astype(np.int64)
        return out

    coarse = None
    for name, (bucket, weight) in buckets.items():
        one = resample(bars, bucket).withColumns({"timeframe": F.lit(name), "weight": F.lit(weight)})
        coarse = one if coarse is None else coarse.union(one)
    marked = along_bars(coarse, {"top": "long", "bottom": "long"}, run, by=("symbol", "timeframe"))
    sides = F.array(F.struct(F.lit("resistance").alias("side"), F.col("high").alias("price"), F.col("top").alias("on")), F.struct(F.lit("support").alias("side"), F.col("low").alias("price"), F.col("bottom").alias("on")))
    return marked.withColumn("s", F.explode(sides)).where("s.on = 1").select("symbol", "open_time", "s.side", "timeframe", "weight", "s.price", "volume")


def multi_timeframe_levels(bars: DataFrame, buckets: dict[str, tuple[Column, float]], share: float = 0.005, least: int = 2, volume_weight: float = 1.0, major: float = 5.0) -> DataFrame:
    """Clusters of pivots over timeframes: symbol, side, cluster, price (volume weighted), touches, score, major.

    Score: touches, timeframe weights and volumes relative to the cluster's mean, summed,
    times the mean of exp(-days/30) before the cluster's last touch.
    """
    # two points in reach make each other cores, so that islands are the clusters
    clustered = (islands if least <= 2 else density)(timeframe_pivots(bars, buckets), ["symbol", "side"], "price", share, least)
    clustered = clustered.withColumn("last", F.max("open_time").over(Window.partitionBy("symbol", "side", "cluster")))
    days = F.floor((F.unix_seconds(F.col("last").cast("timestamp")) - F.unix_seconds(F.col("open_time").cast("timestamp"))) / 86400)
    # volumes over their mean sum to the number of touches
    relative = F.when(F.sum("volume") > 0, F.count("*")).otherwise(0) * volume_weight
    out = clustered.groupBy("symbol", "side", "cluster").agg(
        F.coalesce(F.try_divide(F.sum(F.col("price") * F.col("volume")), F.sum("volume")), F.avg("price")).alias("price"), F.count("*").alias("touches"), ((F.count("*") + F.sum("weight") + relative) * F.avg(F.exp(-days / 30))).alias("score"),
    )
    return out.withColumn("major", F.col("score") >= major)
