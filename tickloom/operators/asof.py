"""As-of and interval joins as DataFrame rewrites.

Spark has no as-of or range join. An as-of join here is a union with a window
(one shuffle, no product of both sides). An interval join deals both sides by
bucket of the position, so that a row meets only the buckets its interval touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: str, value: str, by: str = "symbol", direction: str = "backward", bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """``left`` with ``value`` of the last row of ``right`` at or before it (or the first at or after it).

    Ties in time: a right row at the same time counts. Null values are passed over.
    ``bucket`` (times to buckets that follow their order, such as days) splits a symbol: a window holds
    one bucket, and what earlier buckets end with comes from a table with one row for each.
    """
    back = direction == "backward"
    own = F.struct(*left.columns)
    rows = left.select(F.col(by).alias("_by"), F.col(on).alias("_at"), F.lit(1 if back else 0).alias("_src"), own.alias("_row"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_value"))
    other = right.select(F.col(by).alias("_by"), F.col(on).alias("_at"), F.lit(0 if back else 1).alias("_src"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"))
    both = rows.union(other)
    toward = (lambda c: F.col(c).asc()) if back else (lambda c: F.col(c).desc())
    # forward is backward along descending times, since only frames from the first row on are linear
    upto = lambda keys: Window.partitionBy(*keys).orderBy(toward("_at"), toward("_src")).rowsBetween(Window.unboundedPreceding, 0)
    if bucket is None:
        found = both.withColumn("_found", F.last("_value", True).over(upto(["_by"])))
    else:
        both = both.withColumn("_bucket", bucket(F.col("_at")))
        held = F.when(F.col("_value").isNotNull(), F.col("_at"))
        totals = both.groupBy("_by", "_bucket").agg((F.max_by if back else F.min_by)("_value", held).alias("_last"))
        earlier = Window.partitionBy("_by").orderBy(toward("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select("_by", "_bucket", F.last("_last", True).over(earlier).alias("_before"))
        within = both.withColumn("_own", F.last("_value", True).over(upto(["_by", "_bucket"])))
        found = within.join(offsets, within["_by"].eqNullSafe(offsets["_by"]) & within["_bucket"].eqNullSafe(offsets["_bucket"])).select("_row", F.coalesce("_own", "_before").alias("_found"))
    return found.where(F.col("_row").isNotNull()).select("_row.*", F.col("_found").alias(value))


def interval_join(events: DataFrame, bars: DataFrame, start: str, end: str, width: int, extra: Column | None = None, by: str = "symbol", at: str = "bar_id") -> DataFrame:
    """Events with every bar whose position lies in [start, end], both included; left join.

    ``width``: of the buckets; intervals no longer touch two of them at most.
    ``extra``: a further condition on columns of both sides. Bar columns that events
    have too carry the prefix ``bar_``.
    """
    spread = events.withColumn("_bucket", F.explode(F.sequence((F.col(start) / width).cast("long"), (F.col(end) / width).cast("long"))))
    own = bars.select(*[F.col(c).alias(f"bar_{c}" if c in events.columns else c) for c in bars.columns]).withColumn("_bar_bucket", (F.col(f"bar_{at}" if at in events.columns else at) / width).cast("long"))
    by_, at_ = (f"bar_{c}" if c in events.columns else c for c in (by, at))
    cond = (spread[by] == own[by_]) & (F.col("_bucket") == F.col("_bar_bucket")) & F.col(at_).between(F.col(start), F.col(end))
    return spread.join(own, cond if extra is None else cond & extra, "left").drop("_bucket", "_bar_bucket")
