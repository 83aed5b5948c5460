"""Steps of recurrences that no window can express: each value depends on the result at the row before.

They take arrays and the state before them and give back the state after them, so that
``scans`` can run a symbol in pieces. ``along_bars`` is for what needs a whole symbol at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


def along_bars(df: DataFrame, outputs: dict[str, str], compute: Callable[[pd.DataFrame], dict[str, np.ndarray]], order: tuple[str, ...] = ("bar_id",), by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Add columns that ``compute`` makes from the ordered rows of each symbol (or other group).

    ``outputs``: column name to "double" or "long".
    """
    kinds = {"double": DoubleType(), "long": LongType()}
    schema = StructType([*df.schema.fields, *[StructField(c, kinds[k]) for c, k in outputs.items()]])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(order), kind="stable").reset_index(drop=True)
        for name, value in compute(group).items():
            value = pd.Series(value)
            group[name] = value.where(~np.isnan(value.astype(float)), None) if outputs[name] == "double" else value
        return group

    return df.groupBy(*by).applyInPandas(run, schema)


def cusum(price: np.ndarray, threshold: np.ndarray, state: tuple[float, float, float] = (0.0, 0.0, np.nan)) -> tuple[np.ndarray, tuple[float, float, float]]:
    """Events of a symmetric CUSUM filter (-1, 0 or 1) and its state: rise, fall and last price.

    The fall is tested first; only the side that fires is reset; a NaN threshold never fires.
    """
    out = np.zeros(len(price), np.int64)
    up, down, last = state
    for i, (now, limit) in enumerate(zip(price.tolist(), threshold.tolist())):
        if last == last:
            up, down = max(0.0, up + (now - last)), min(0.0, down + (now - last))
            if down < -limit:
                down, out[i] = 0.0, -1
            elif up > limit:
                up, out[i] = 0.0, 1
        last = now
    return out, (up, down, last)


def flow_bars(buy: np.ndarray, sell: np.ndarray, threshold: float, mode: str, carry: bool, state: tuple[float, ...] = (0.0, 0.0)) -> tuple[np.ndarray, tuple[float, float]]:
    """Direction of the tick that closes a bar (else 0) and the net flow left; a bar closes when net flow crosses the threshold.

    ``mode``: abs (either way), pos or neg. Carry-over takes the threshold off instead of all.
    """
    way, net = np.zeros(len(buy), np.int64), state[0]
    for i, (b, s) in enumerate(zip(buy.tolist(), sell.tolist())):
        net += b - s
        if (mode in ("abs", "pos") and net >= threshold) or (mode in ("abs", "neg") and net <= -threshold):
            side = 1 if net > 0 else -1
            way[i] = side
            net = net - side * threshold if carry else 0.0
    return way, (net, 0.0)


def volume_bars(buy: np.ndarray, sell: np.ndarray, threshold: float, wait_for: str, carry: bool, state: tuple[float, ...] = (0.0, 0.0)) -> tuple[np.ndarray, tuple[float, float]]:
    """Direction of the tick that closes a bar (else 0) and what was bought and sold since; a bar closes when
    bought, sold or total volume reaches the threshold.

    Carry-over takes the threshold off the side that the bar goes by, and leaves the other.
    """
    way, (b, s) = np.zeros(len(buy), np.int64), state
    for i, (more, less) in enumerate(zip(buy.tolist(), sell.tolist())):
        b, s = b + more, s + less
        side = 0
        if wait_for == "buy" and b >= threshold:
            side = 1
        elif wait_for == "sell" and s >= threshold:
            side = -1
        elif wait_for == "either" and b + s >= threshold:
            side = 1 if b >= s else -1
        if side:
            way[i] = side
            if carry:
                b, s = (b - threshold, s) if side > 0 else (b, s - threshold)
            else:
                b = s = 0.0
    return way, (b, s)


class VolumeMap:
    """What ``volume_bars`` without carry-over leaves after some rows, for every state before them.

    A bar that is open before the rows closes at the first row whose running volume makes up what it
    lacks; from there on the bars depend on that row only, and those that close at one row are the same.
    So the state after the rows is a step function of the volume before them. Sums may differ from
    the kernel's in their last digits.
    """

    def __init__(self, threshold: float, wait_for: str) -> None:
        self.threshold, self.wait_for = threshold, wait_for
        self.all = np.zeros(2)  # bought and sold so far
        self.most = 0.0  # running volume so far
        self.need = np.zeros(0)  # least volume before the rows that closes at a row
        self.of = np.zeros(0, np.int64)  # the state it leaves
        self.left = np.zeros((0, 2))

    def measure(self, sides: np.ndarray) -> np.ndarray:
        """The volume that bars go by."""
        return sides[..., 0] if self.wait_for == "buy" else sides[..., 1] if self.wait_for == "sell" else sides[..., 0] + sides[..., 1]

    def add(self, buy: np.ndarray, sell: np.ndarray) -> None:
        """Go on with further rows."""
        n, limit, sides = len(buy), self.threshold, np.stack([buy, sell], 1)
        ran = np.maximum.accumulate(np.cumsum(self.measure(sides)))
        # the last close after a close at each row, by jumping over ever more bars
        last = np.searchsorted(ran, ran + limit)
        last = np.where(last < n, last, np.arange(n))
        while (last[last] != last).any():
            last = last[last]
        closes = np.searchsorted(ran, limit - self.measure(self.left))
        before = np.concatenate([[0.0], ran[:-1]])
        new = np.flatnonzero((ran > before) & (self.most + before < limit))
        at = np.concatenate([np.where(closes < n, last[np.minimum(closes, n - 1)], -1), last[new]])
        sums = np.cumsum(sides, 0)
        left = np.concatenate([self.left, np.zeros((len(new), 2))])
        left = np.where(at[:, None] < 0, left + sums[-1], sums[-1] - sums[at])
        states = np.unique(at[at >= 0])
        if len(states) <= 100:  # in the kernel's order, so that digits are equal
            for k in states.tolist():
                left[at == k] = np.cumsum(sides[k + 1 :], 0)[-1] if k + 1 < n else 0.0
        self.need = np.concatenate([self.need, limit - (self.most + ran[new])])
        self.of = np.concatenate([self.of, len(self.left) + np.arange(len(new))])
        self.left, merged = np.unique(left, axis=0, return_inverse=True)
        self.of = merged.ravel()[self.of]
        self.most, self.all = self.most + max(0.0, ran[-1]), self.all + sums[-1]

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """Least volumes before the rows, and the states they leave; at -inf what is added to any state."""
        need, of = self.need[::-1], self.of[::-1]
        own = np.ones(len(of), bool)
        own[1:] = of[1:] != of[:-1]
        return np.concatenate([[-np.inf], need[own]]), np.concatenate([self.all[None], self.left[of[own]]])

    def leaves(self, state: tuple[float, float], need: np.ndarray, left: np.ndarray) -> tuple[float, float]:
        """The state after rows with these steps."""
        k = int(np.searchsorted(need, float(self.measure(np.array(state))), "right")) - 1
        b, s = left[k].tolist()
        return (b, s) if k else (state[0] + b, state[1] + s)


def hysteresis(x: np.ndarray, upper: float, lower: float, on: int = 0) -> np.ndarray:
    """1 from where x exceeds ``upper`` until it falls under ``lower``, else 0; ``on``: before the first value."""
    out = np.zeros(len(x), np.int64)
    for i, v in enumerate(x):
        if not on and v > upper:
            on = 1
        elif on and v < lower:
            on = 0
        out[i] = on
    return out


def kalman_gains(n: int, q: float, r: float, p: float) -> np.ndarray:
    """The gains of a one-dimensional random walk seen with noise; they do not depend on what is seen."""
    out = np.zeros(n)
    for i in range(n):
        p = p + q if i else p
        out[i] = p / (p + r)
        p *= 1 - out[i]
    return out
