"""Rolling order statistics: the values in a frame are held in an index by rank, not sorted anew at each row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tickloom.functions import pieces


class Held:
    """Counts of the held values by rank among all values of a piece, as a Fenwick tree.

    Holding, dropping, counting below a rank and finding the k-th value take steps as many as the
    logarithm of the number of distinct values, whatever the frame.
    """

    def __init__(self, distinct: np.ndarray) -> None:
        self.values = distinct.tolist()
        self.tree = [0] * (len(self.values) + 1)
        self.n = 0
        self._top = 1 << max(0, len(self.values).bit_length() - 1)

    def add(self, rank: int, by: int = 1) -> None:
        self.n += by
        i, tree = rank + 1, self.tree
        while i < len(tree):
            tree[i] += by
            i += i & -i

    def below(self, rank: int) -> int:
        """How many held values have a smaller rank."""
        out, i = 0, rank
        while i:
            out += self.tree[i]
            i &= i - 1
        return out

    def kth(self, k: int) -> float:
        """The k-th smallest held value, from 0."""
        at, step, tree = 0, self._top, self.tree
        while step:
            if at + step < len(tree) and tree[at + step] <= k:
                at += step
                k -= tree[at]
            step >>= 1
        return self.values[at]

    def quantile(self, q: float) -> float:
        """Between the two nearest held values, linearly."""
        place = q * (self.n - 1)
        low = int(place)
        a = self.kth(low)
        return a if place == low else a + (self.kth(low + 1) - a) * (place - low)

    def _distance(self, k: int, centre: float) -> float:
        """The k-th smallest distance from the median: both sides of it are sorted by distance."""
        half = (self.n + 1) // 2
        left, right = lambda i: centre - self.kth(half - 1 - i), lambda j: self.kth(half + j) - centre
        lo, hi = max(0, k + 1 - (self.n - half)), min(k + 1, half)
        while lo < hi:  # how many of the k + 1 smallest lie to the left
            mid = (lo + hi) // 2
            if left(mid) >= right(k - mid):
                hi = mid
            else:
                lo = mid + 1
        near = [left(lo - 1)] if lo else []
        return max([*near, right(k - lo)] if k >= lo else near)

    def mad(self) -> float:
        """Median distance from the median."""
        centre = self.quantile(0.5)
        return (self._distance((self.n - 1) // 2, centre) + self._distance(self.n // 2, centre)) / 2


def _along(x: np.ndarray, n: int, outputs: dict[str, str | float]) -> dict[str, np.ndarray]:
    distinct = np.unique(x[~np.isnan(x)])
    rank = np.where(np.isnan(x), -1, np.searchsorted(distinct, x)).tolist()
    held, out = Held(distinct), {o: np.full(len(x), np.nan) for o in outputs}
    for i, now in enumerate(rank):
        if i >= n and rank[i - n] >= 0:
            held.add(rank[i - n], -1)
        if now >= 0:
            held.add(now)
        if held.n == n:
            for o, kind in outputs.items():
                out[o][i] = held.mad() if kind == "mad" else held.below(now) / n if kind == "percent_rank" else held.quantile(0.5 if kind == "median" else kind)
    return out


def rolling_order(bars: DataFrame, column: str, n: int, outputs: dict[str, str | float], rows: int | None = None) -> DataFrame:
    """Order statistics of the last n bars of a symbol; null with fewer than n values.

    ``outputs``: name to median, mad (median distance from the median), percent_rank (share of the
    frame that is smaller than the row's value) or a number from 0 to 1 (quantile, linear between
    values). Numbers of bars must be dense. Pieces of ``rows`` numbers with n - 1 rows before them are
    groups of their own.
    """
    if n < 1 or unknown(outputs):
        raise ValueError(f"frames of at least one bar, and median, mad, percent_rank or a quantile; not {unknown(outputs)}")
    rows = pieces.ROWS if rows is None else rows
    own = F.col("bar_id")
    # only the value travels with the halo
    seen = bars.select("symbol", "bar_id", F.col(column).cast("double").alias("_x"), F.explode(F.sequence(F.floor(own / rows), F.floor((own + (n - 1)) / rows))).alias("_piece"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bar_id")
        made = g[["symbol", "bar_id"]].assign(**_along(g["_x"].to_numpy(float), n, outputs))
        return made[g["bar_id"] // rows == g["_piece"]]

    kinds = StructType([bars.schema["symbol"], bars.schema["bar_id"], *[StructField(o, DoubleType()) for o in outputs]])
    found = seen.groupBy("symbol", "_piece").applyInPandas(run, kinds)
    clean = found.select("symbol", "bar_id", *[F.nanvl(F.col(o), F.lit(None).cast("double")).alias(o) for o in outputs])
    return bars.drop(*outputs).join(clean, ["symbol", "bar_id"], "left")


def unknown(outputs: dict[str, str | float]) -> list:
    """Kinds that are none."""
    return [k for k in outputs.values() if k not in ("median", "mad", "percent_rank") and not (isinstance(k, (int, float)) and 0 <= k <= 1)]
