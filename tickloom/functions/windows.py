"""Rolling, cumulative and segment windows over the bars of a symbol."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

_keys: ContextVar[tuple[str, ...]] = ContextVar("keys", default=("symbol",))


@contextmanager
def keyed_by(*columns: str) -> Iterator[None]:
    """Windows made inside are partitioned by these columns (see ``pieces.split``)."""
    token = _keys.set(columns)
    try:
        yield
    finally:
        _keys.reset(token)


def by_bar():
    """All windows share this partitioning and order, so a plan sorts once."""
    return Window.partitionBy(*_keys.get()).orderBy("bar_id")


EPS = 1e-9


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def frame(n: int):
    """The last n bars."""
    return by_bar().rowsBetween(-(n - 1), 0)


def rolling(agg: Callable[[Column], Column], x: str | Column, n: int, min_periods: int | None = None) -> Column:
    """An aggregate of the last n bars; null with fewer than ``min_periods`` (n) values."""
    x, w = col(x), frame(n)
    return F.when(F.count(x).over(w) >= (n if min_periods is None else min_periods), agg(x).over(w))


def ahead(agg: Callable[[Column], Column], x: str | Column, n: int) -> Column:
    """An aggregate of the next n bars; null with fewer."""
    x, w = col(x), by_bar().rowsBetween(1, n)
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


def behind(agg: Callable[[Column], Column], x: str | Column, n: int) -> Column:
    """An aggregate of the n bars before this one; null with fewer."""
    x, w = col(x), by_bar().rowsBetween(-n, -1)
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


def lag(x: str | Column, k: int = 1) -> Column:
    return F.lag(col(x), k).over(by_bar())


def change(x: str | Column) -> Column:
    return col(x) - lag(x)


def pct_change(x: str | Column) -> Column:
    return F.try_divide(col(x), lag(x)) - 1


def running(agg: Callable[[Column], Column], x: str | Column) -> Column:
    return agg(col(x)).over(by_bar().rowsBetween(Window.unboundedPreceding, 0))


def whole(agg: Callable[[Column], Column], x: str | Column) -> Column:
    """An aggregate of all bars of the symbol."""
    return agg(col(x)).over(Window.partitionBy("symbol"))


def values(x: str | Column, n: int) -> Column:
    """The last n values as an array."""
    return F.collect_list(col(x)).over(frame(n))


def mean_abs_deviation(x: str | Column, n: int) -> Column:
    """Mean distance from their mean of the last n values; null with fewer."""
    v = values(x, n)
    mean = F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / n
    return F.when(F.size(v) == n, F.aggregate(F.transform(v, lambda y: F.abs(y - mean)), F.lit(0.0), lambda a, b: a + b) / n)


def clip(x: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Bounded values; null stays null."""
    out = x
    if high is not None:
        out = F.least(out, F.lit(high) if not isinstance(high, Column) else high)
    if low is not None:
        out = F.greatest(out, F.lit(low) if not isinstance(low, Column) else low)
    return F.when(x.isNotNull(), out)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
