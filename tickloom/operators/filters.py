"""Signal filters along the bars of a symbol."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tickloom.functions import pieces
from tickloom.functions.kernels import along_bars, hysteresis, kalman_gains
from tickloom.functions.scans import Affine, handed_over, recur
from tickloom.functions.windows import by_bar, change, lag


#: Share of an old value that a filter may still hold where its memory ends.
FORGOTTEN = 1e-20


def _memory(modulus: float) -> int:
    """Rows after which a mode that decays by ``modulus`` a row is forgotten."""
    return 1 if modulus <= 0 else math.ceil(math.log(FORGOTTEN) / math.log(modulus))


def in_blocks(df: DataFrame, column: str, output: str, f: Callable[[np.ndarray, dict], np.ndarray], reach: int, align: int = 1, rows: int | None = None, given: tuple[str, ...] = ()) -> DataFrame:
    """Add a column that ``f`` makes from the values of a piece and of ``reach`` rows on both sides of it.

    For filters that forget: what the cut ends of a piece change must have died out ``reach`` rows from
    them, so that pieces give what the whole series would. Only at the first and last row of a symbol
    does ``f`` meet a true end. Pieces and their halos begin a multiple of ``align`` rows after the first
    row. Numbers must be dense. A null spreads over the memory of a filter at least and over its
    piece at most. ``given``: columns that are equal along a symbol and that ``f`` gets by name.
    """
    up = lambda k: -(-k // align) * align
    reach = up(reach)
    rows = up(max(pieces.ROWS if rows is None else rows, reach))
    first = df.groupBy("symbol").agg(F.min("bar_id").alias("_first"))
    own = F.col("bar_id") - F.col("_first")
    seen_by = F.sequence(F.floor(F.greatest(own - reach, F.lit(0)) / rows), F.floor((own + reach) / rows))
    spread = df.join(first, "symbol").withColumn("_piece", F.explode(seen_by))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bar_id").reset_index(drop=True)
        mine = ((g["bar_id"] - g["_first"]) // rows == g["_piece"]).to_numpy()
        if not mine.any():
            return g.assign(**{output: 0.0})[:0]
        g[output] = f(g[column].to_numpy(float), {c: g[c].iloc[0] for c in given})
        return g[mine]

    kinds = StructType([*spread.schema.fields, StructField(output, DoubleType())])
    made = spread.groupBy("symbol", "_piece").applyInPandas(run, kinds)
    return made.select(*[c for c in df.columns if c not in given], F.nanvl(F.col(output), F.lit(None).cast("double")).alias(output))


def kalman_filter(df: DataFrame, column: str = "close", output: str = "kalman", q: float = 0.01, r: float = 0.1) -> DataFrame:
    """States of a random walk seen with noise."""
    # the gain settles within few rows; later rows share the last one
    gains = kalman_gains(1000, q, r, 1.0)

    def coefs(x: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = np.where(i == 0, 1.0, gains[np.clip(i, 0, len(gains) - 1)])
        return 1 - g, g * x

    return recur(df, {output: (column, Affine(coefs))})


def hp_trend(x: np.ndarray, lamb: float = 1600.0) -> np.ndarray:
    """Trend of the Hodrick-Prescott filter: solves (I + lamb*K'K) t = x, K second
    differences, by elimination in the band of five diagonals."""
    n = len(x)
    if n < 3:
        return x.astype(float)
    d, e, f = np.ones(n), np.zeros(n), np.zeros(n)
    for i in range(n - 2):
        for a, u in ((0, 1.0), (1, -2.0), (2, 1.0)):
            d[i + a] += lamb * u * u
        e[i] += lamb * -2.0
        e[i + 1] += lamb * -2.0
        f[i] += lamb
    y = x.astype(float).copy()
    for i in range(n):  # symmetric elimination
        for k, off in ((1, e), (2, f)):
            if i + k < n:
                m = off[i] / d[i]
                y[i + k] -= m * y[i]
                d[i + k] -= m * off[i]
                if k == 1 and i + 2 < n:
                    e[i + 1] -= m * f[i]
    t = np.zeros(n)
    for i in range(n - 1, -1, -1):
        s = y[i] - (e[i] * t[i + 1] if i + 1 < n else 0) - (f[i] * t[i + 2] if i + 2 < n else 0)
        t[i] = s / d[i]
    return t


def hodrick_prescott(df: DataFrame, column: str = "close", lamb: float = 1600.0, rows: int | None = None) -> DataFrame:
    """Trend and cycle; the pull of a row dies out as the roots of the filter say, so pieces are solved apart."""
    inside = [abs(z) for z in np.roots([lamb, -4 * lamb, 6 * lamb + 1, -4 * lamb, lamb]) if abs(z) < 1]
    out = in_blocks(df, column, "trend", lambda x, _: hp_trend(x, lamb), _memory(max(inside, default=0.0)), rows=rows)
    return out.withColumn("cycle", F.col(column) - F.col("trend"))


def butter(order: int, cutoff: float | tuple[float, float], kind: str = "low") -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital Butterworth filter.

    ``cutoff``: a share of half the rate, or two for kinds band and stop. The analog
    prototype is moved to the band and mapped by the bilinear transform.
    """
    if kind not in ("low", "high", "band", "stop"):
        raise ValueError(f"unknown kind {kind!r}; low, high, band or stop")
    if (kind in ("band", "stop")) != isinstance(cutoff, (tuple, list)):
        raise ValueError("band and stop take two cutoffs, low and high one")
    edges = [4 * math.tan(math.pi * c / 2) for c in (cutoff if isinstance(cutoff, (tuple, list)) else [cutoff])]
    pole = np.exp(1j * math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind == "low":
        poles, zeros = edges[0] * pole, np.zeros(0)
    elif kind == "high":
        poles, zeros = edges[0] / pole, np.zeros(order)
    else:
        width, middle = edges[1] - edges[0], edges[0] * edges[1]
        half = (width * pole if kind == "band" else width / pole) / 2
        root = np.sqrt(half**2 - middle + 0j)
        poles = np.concatenate([half + root, half - root])
        zeros = np.zeros(order) if kind == "band" else np.concatenate([1j * np.full(order, math.sqrt(middle)), -1j * np.full(order, math.sqrt(middle))])
    z, p = (4 + zeros) / (4 - zeros), (4 + poles) / (4 - poles)
    z = np.concatenate([z, -np.ones(len(p) - len(z))])
    b, a = np.real(np.poly(z)), np.real(np.poly(p))
    # gain one where the band passes: at rest, at half the rate, or in the middle of the band
    at = {"low": 1.0, "stop": 1.0, "high": -1.0}.get(kind) or np.exp(2j * math.atan(math.sqrt(edges[0] * edges[-1]) / 4))
    return b * abs(np.polyval(a, at) / np.polyval(b, at)), a


def butter_low(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """The low pass of ``butter``."""
    return butter(order, cutoff)


def iir(b: np.ndarray, a: np.ndarray, x: np.ndarray, start: float) -> np.ndarray:
    """Filter that begins at rest in a constant ``start``: the response to one impulse, up to the
    filter's memory, meets what differs from ``start``."""
    h = np.zeros(min(len(x), memory(a)))
    for i in range(len(h)):
        back = h[max(0, i - len(a) + 1) : i][::-1]
        h[i] = (b[i] if i < len(b) else 0.0) - a[1 : len(back) + 1] @ back
    return start * b.sum() / a.sum() + np.convolve(x - start, h)[: len(x)]


def memory(a: np.ndarray) -> int:
    """Rows after which a filter with this denominator has forgotten a value."""
    return len(a) + _memory(float(np.abs(np.roots(a)).max(initial=0.0)))


def butterworth(df: DataFrame, column: str = "close", order: int = 3, cutoff: float | tuple[float, float] = 0.1, kind: str = "low", rows: int | None = None) -> DataFrame:
    """Zero-phase low, high, band or stop filter: forward and backward over the series with
    odd extension at both ends, piece by piece with the filter's memory on both sides."""
    b, a = butter(order, cutoff, kind)

    def run(x: np.ndarray, _: dict) -> np.ndarray:
        pad = min(3 * len(a), len(x) - 1)
        if pad < 1:
            return x
        long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
        forth = iir(b, a, long, long[0])
        return iir(b, a, forth[::-1], forth[-1])[::-1][pad : pad + len(x)]

    return in_blocks(df, column, "butter", run, memory(a) + 3 * len(a), rows=rows)


def savgol_weights(window: int, degree: int, at: int = 0) -> list[float]:
    """Weights of the value ``at`` steps from the middle of a polynomial least-squares fit."""
    half = window // 2
    basis = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True)
    return [float(w) for w in np.array([float(at) ** k for k in range(degree + 1)]) @ np.linalg.pinv(basis)]


def savitzky_golay(df: DataFrame, column: str = "close", window: int = 11, degree: int = 2) -> DataFrame:
    """Smoothed values by fixed weights of neighbours (native).

    Within half a window of an end the fit of the first (last) window is read off; a
    series shorter than a window has no values.
    """
    half, w = window // 2, by_bar()
    out = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy("symbol"))})

    def fit(at: int):
        # the middle of the window lies ``at`` bars before the row
        return sum((F.lead(column, k - at).over(w) * x for k, x in zip(range(-half, half + 1), savgol_weights(window, degree, at))), F.lit(0.0))

    value = F.when(F.col("_n") < window, F.lit(None).cast("double"))
    for at in range(1, half + 1):
        value = value.when(F.col("_i") == half - at, fit(-at)).when(F.col("_i") == F.col("_n") - 1 - half + at, fit(at))
    return out.withColumn("savgol", value.otherwise(fit(0))).drop("_i", "_n")


def daubechies(n: int) -> np.ndarray:
    """The scaling filter of the Daubechies wavelet with n vanishing moments (1: Haar)."""
    # the polynomial in y = (2 - z - 1/z) / 4, whose roots inside the circle give the filter
    y = np.roots([math.comb(n - 1 + k, k) for k in range(n - 1, -1, -1)]) if n > 1 else np.zeros(0)
    inside = []
    for r in y:
        pair = np.roots([1, -(2 - 4 * r), 1])
        inside.append(pair[np.argmin(np.abs(pair))])
    h = np.real(np.poly(np.concatenate([-np.ones(n), inside])))
    return h * math.sqrt(2) / h.sum()


def _mirrored(x: np.ndarray, k: int) -> np.ndarray:
    """k more values at both ends, mirrored (again and again for short series)."""
    n = len(x)
    at = np.arange(-k, n + k) % (2 * n)
    return x[np.where(at < n, at, 2 * n - 1 - at)]


def wavelet_steps(x: np.ndarray, h: np.ndarray, levels: int) -> list[np.ndarray]:
    """Details of each level, finest first, and the approximation left, with mirrored ends."""
    g = h[::-1] * (-1.0) ** np.arange(len(h))
    out = []
    for _ in range(levels):
        long = _mirrored(x, len(h) - 1)
        out.append(np.correlate(long, g, "valid")[1::2] if len(h) > 2 else np.correlate(_mirrored(x, 1), g, "valid")[1::2])
        x = np.correlate(long, h, "valid")[1::2] if len(h) > 2 else np.correlate(_mirrored(x, 1), h, "valid")[1::2]
    return [*out, x]


def wavelet_join(steps: list[np.ndarray], h: np.ndarray, n: int) -> np.ndarray:
    """The series (n values) of what ``wavelet_steps`` made."""
    g = h[::-1] * (-1.0) ** np.arange(len(h))
    sizes = [n]
    for _ in steps[:-1]:
        sizes.append((sizes[-1] + len(h) - 1) // 2)
    x = steps[-1]
    for d, size in zip(steps[-2::-1], sizes[-2::-1]):
        wide = np.zeros((2, 2 * len(d)))
        wide[0, ::2], wide[1, ::2] = x[: len(d)], d
        full = np.convolve(wide[0], h) + np.convolve(wide[1], g)
        x = full[len(h) - 2 : len(h) - 2 + size]
    return x


def noise_limit(details: np.ndarray, n: int) -> float:
    """The universal threshold from the finest details of n values."""
    return float(np.median(np.abs(details)) / 0.6745 * math.sqrt(2 * math.log(n)))


def wavelet_denoise(x: np.ndarray, family: int = 1, levels: int = 3, mode: str = "soft", limit: float | None = None) -> np.ndarray:
    """Wavelet shrinkage of details by the universal threshold (or ``limit``), soft or hard."""
    if mode not in ("soft", "hard"):
        raise ValueError("mode is 'soft' or 'hard'")
    if len(x) < 2:
        return x
    h = daubechies(family)
    steps = wavelet_steps(x, h, levels)
    limit = noise_limit(steps[0], len(x)) if limit is None else limit
    for k in range(levels):
        d = steps[k]
        steps[k] = np.sign(d) * np.maximum(np.abs(d) - limit, 0) if mode == "soft" else np.where(np.abs(d) > limit, d, 0)
    return wavelet_join(steps, h, len(x))


def haar_denoise(x: np.ndarray, levels: int = 3) -> np.ndarray:
    """Haar wavelet shrinkage (soft)."""
    return wavelet_denoise(x, 1, levels)


def _limits(df: DataFrame, column: str, h: np.ndarray, rows: int) -> DataFrame:
    """The universal threshold of each symbol (symbol, _limit) from the finest details of all pieces.

    Detail k is made from the values 2k + 2 - len(h) to 2k + 1; the last piece also has those of the mirrored end.
    """
    reach = 2 * len(h)
    ends = df.groupBy("symbol").agg(F.min("bar_id").alias("_first"), F.count("*").alias("_n"))
    own = F.col("bar_id") - F.col("_first")
    seen_by = F.sequence(F.floor(F.greatest(own - reach, F.lit(0)) / rows), F.floor((own + reach) / rows))
    spread = df.select("symbol", "bar_id", F.col(column).cast("double").alias("_x")).join(ends, "symbol").select("symbol", own.alias("_i"), "_n", "_x", F.explode(seen_by).alias("_piece"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_i")
        piece, n, at = int(g["_piece"].iloc[0]), int(g["_n"].iloc[0]), int(g["_i"].iloc[0])
        size = np.zeros(0)
        if piece * rows < n and n > 1:
            found = wavelet_steps(g["_x"].to_numpy(float), h, 1)[0]
            last = (n + len(h) - 1) // 2 if (piece + 1) * rows >= n else (piece + 1) * rows // 2
            size = np.abs(found[piece * rows // 2 - at // 2 : last - at // 2])
        return pd.DataFrame({"symbol": np.full(len(size), g["symbol"].iloc[0], object), "_size": size})

    sizes = spread.groupBy("symbol", "_piece").applyInPandas(run, StructType([df.schema["symbol"], StructField("_size", DoubleType())]))
    middle = pieces.medians(pieces.written(sizes, "details"), "_size")
    return ends.join(middle, "symbol").select("symbol", (F.col("median") / 0.6745 * F.sqrt(2 * F.log("_n"))).alias("_limit"))


def wavelet(df: DataFrame, column: str = "close", levels: int = 3, family: int = 1, mode: str = "soft", rows: int | None = None) -> DataFrame:
    """Denoised values; ``family``: vanishing moments (1: Haar, 8: db8). The threshold is that of the whole
    symbol; details are shrunk piece by piece, with as many rows on both sides as all levels reach."""
    if mode not in ("soft", "hard"):
        raise ValueError("mode is 'soft' or 'hard'")
    h, rows = daubechies(family), 2 * -(-(pieces.ROWS if rows is None else rows) // 2)
    met = df.join(_limits(df, column, h, max(rows, 2 * len(h))), "symbol", "left")
    shrunk = lambda x, given: wavelet_denoise(x, family, levels, mode, given["_limit"])
    return in_blocks(met, column, "wavelet", shrunk, len(h) << (levels + 1), 1 << levels, rows, ("_limit",))


def wavelet_levels(df: DataFrame, keep: list[int], column: str = "close", levels: int = 3, family: int = 1, rows: int | None = None) -> DataFrame:
    """The part of a series in some levels: 1 (finest) to ``levels``, 0 the approximation."""
    h = daubechies(family)

    def run(x: np.ndarray, _: dict) -> np.ndarray:
        if len(x) < 2:
            return x
        steps = wavelet_steps(x, h, levels)
        kept = [s if (k + 1 if k < levels else 0) in keep else np.zeros(len(s)) for k, s in enumerate(steps)]
        return wavelet_join(kept, h, len(x))

    return in_blocks(df, column, "wavelet_part", run, len(h) << (levels + 1), 1 << levels, rows)


def _spline(at: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """A natural cubic spline through (at, y) at 0..n-1; a line through two points."""
    grid = np.arange(n, dtype=float)
    if len(at) < 3:
        return np.interp(grid, at, y)
    h = np.diff(at)
    slope = np.diff(y) / h
    m = np.zeros(len(at))
    d, r = 2 * (h[:-1] + h[1:]), 6 * np.diff(slope)
    for i in range(1, len(d)):
        w = h[i] / d[i - 1]
        d[i] -= w * h[i]
        r[i] -= w * r[i - 1]
    for i in range(len(d) - 1, -1, -1):
        m[i + 1] = (r[i] - (h[i + 1] * m[i + 2] if i + 1 < len(d) else 0)) / d[i]
    k = np.clip(np.searchsorted(at, grid, "right") - 1, 0, len(h) - 1)
    t, u = grid - at[k], at[k + 1] - grid
    return (m[k] * u**3 + m[k + 1] * t**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * t


def modes(x: np.ndarray, most: int = 8, sifts: int = 10) -> list[np.ndarray]:
    """Intrinsic modes of a series, fastest first, and the trend left; they sum to the series.

    Each mode takes off the mean of spline envelopes ``sifts`` times; the ends belong to
    both envelopes. It ends where fewer than two peaks or troughs are left.
    """
    out, rest = [], x.astype(float)
    for _ in range(most):
        mode, swings = rest.copy(), True
        for _ in range(sifts):
            inner = np.arange(1, len(mode) - 1)
            top = inner[(mode[1:-1] > mode[:-2]) & (mode[1:-1] >= mode[2:])]
            low = inner[(mode[1:-1] < mode[:-2]) & (mode[1:-1] <= mode[2:])]
            if len(top) < 2 or len(low) < 2:
                swings = False
                break
            ends = lambda k: np.concatenate([[0], k, [len(mode) - 1]])  # noqa: B023,E731
            mode = mode - (_spline(ends(top), mode[ends(top)], len(mode)) + _spline(ends(low), mode[ends(low)], len(mode))) / 2
        if not swings and mode is not rest and np.array_equal(mode, rest):
            break
        out.append(mode)
        rest = rest - mode
        if not swings:
            break
    return [*out, rest]


def empirical_modes(df: DataFrame, column: str = "close", most: int = 4) -> DataFrame:
    """Columns imf_1 .. imf_most (zero where a series has fewer) and ``emd_trend``, which sum to the column."""

    def run(g) -> dict[str, np.ndarray]:
        x = g[column].to_numpy(float)
        found = modes(x, most)
        parts = [*found[:-1], *[np.zeros(len(x))] * (most + 1 - len(found))]
        return {f"imf_{k + 1}": p for k, p in enumerate(parts)} | {"emd_trend": found[-1]}

    return along_bars(df, {f"imf_{k + 1}": "double" for k in range(most)} | {"emd_trend": "double"}, run)


def empirical_filter(df: DataFrame, drop: list[int], column: str = "close", most: int = 4) -> DataFrame:
    """The series without some of its modes (1 is the fastest): column ``emd``."""
    out = empirical_modes(df, column, most)
    kept = sum((F.col(f"imf_{k + 1}") for k in range(most) if k + 1 not in drop), F.col("emd_trend"))
    return out.withColumn("emd", kept).drop("emd_trend", *[f"imf_{k + 1}" for k in range(most)])


def ensemble(df: DataFrame, weights: dict[str, float], output: str = "ensemble") -> DataFrame:
    """Weighted mean of filter columns."""
    total = sum(weights.values())
    out = F.lit(0.0)
    for c, w in weights.items():
        out = out + F.col(c) * w
    return df.withColumn(output, out / total)


#: Bars of a tile of the bubble test: a pair of tiles is one group of a task.
TILE = 1024

_SUMS = ("y", "d", "yy", "yd", "dd", "miss")


def _tile_best(ends: dict[str, np.ndarray], starts: dict[str, np.ndarray], window: int, step: int = 64) -> np.ndarray:
    """The largest statistic of each end over the starts, NaN without one; ``step`` ends at a time."""
    best = np.full(len(ends["bar_id"]), np.nan)
    for lo in range(0, len(best), step):
        some = {c: v[lo : lo + step, None] for c, v in ends.items()}
        n = (some["bar_id"] - starts["bar_id"]).astype(float)
        ok = (n >= window) & (some["miss"] == starts["miss"])
        if not ok.any():
            continue
        sy, sd, syy, syd, sdd = (some[c] - starts[c] for c in _SUMS[:5])
        with np.errstate(divide="ignore", invalid="ignore"):
            vy, cyd, vd = syy - sy * sy / n, syd - sy * sd / n, sdd - sd * sd / n
            beta = cyd / vy
            stat = beta / np.sqrt(np.maximum(vd - beta * cyd, 0) / (n - 2) / vy)
        stat = np.where(ok & np.isfinite(stat), stat, -np.inf).max(axis=1)
        best[lo : lo + step] = np.where(np.isfinite(stat), stat, np.nan)
    return best


def sadf(df: DataFrame, column: str = "close", window: int = 30, rows: int | None = None) -> DataFrame:
    """Supremum over starts of the Dickey-Fuller t statistic (constant, no lags) up to each bar.

    Regresses the move on the last value over every span of at least ``window`` moves that ends at
    the bar, from running sums. The sums are packed in tiles of ``rows`` numbers, and each pair of a
    tile of ends and a tile of starts not after it is a group of its own, so that one series is many
    tasks of bounded size; of a pair only the largest statistic of each end goes on. Spans with a
    missing value are not judged. Null where no span is.
    """
    rows = TILE if rows is None else rows
    x = F.col(column).cast("double")
    value = F.when(~F.isnan(x), x)
    # read several times below, so that what it is made from runs once
    own = pieces.written(df.select("symbol", "bar_id", value.alias("_v")), "series")
    base = own.groupBy("symbol").agg(F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("bar_id"))).alias("_base"))
    centred = own.join(base, "symbol").select("symbol", "bar_id", (F.col("_v") - F.col("_base")).alias("_x"))
    moves = pieces.split(centred, lambda b: b.withColumns({"d": change("_x"), "_y": lag("_x")}), back=1)
    y = F.when(F.col("d").isNotNull(), F.col("_y"))
    parts = moves.select("symbol", "bar_id", y.alias("y"), "d", (y * y).alias("yy"), (y * F.col("d")).alias("yd"), (F.col("d") * F.col("d")).alias("dd"), F.col("d").isNull().cast("double").alias("miss"))
    summed = pieces.running(parts, {f"_{c}": ("sum", c) for c in _SUMS})
    held = F.struct("bar_id", *[F.coalesce(F.col(f"_{c}"), F.lit(0.0)).alias(c) for c in _SUMS])
    tiles = summed.groupBy("symbol", pieces.piece("bar_id", rows).alias("_tile")).agg(F.sort_array(F.collect_list(held)).alias("_rows"))
    tiles = pieces.written(tiles, "tiles")
    names = ("bar_id", *_SUMS)
    reach = tiles.groupBy("symbol").agg(F.min("_tile").alias("_first"), F.max("_tile").alias("_last"))
    placed = tiles.join(reach, "symbol")

    def side(tag: str, own: str, other: str, met: Column) -> DataFrame:
        return placed.select("symbol", F.col("_tile").alias(own), F.explode(met).alias(other), *[F.col(f"_rows.{c}").alias(f"{tag}_{c}") for c in names])

    ends = side("e", "_end", "_start", F.sequence("_first", "_tile"))
    starts = side("s", "_start", "_end", F.sequence("_tile", "_last"))
    key = ["symbol", "_end", "_start"]

    def judged(g: pd.DataFrame) -> pd.DataFrame:
        e, s = ({c: np.asarray(g[f"{tag}_{c}"].iloc[0]) for c in names} for tag in "es")
        found = pd.DataFrame({"symbol": [g["symbol"].iloc[0]] * len(e["bar_id"]), "bar_id": e["bar_id"], "_t": _tile_best(e, s, window)})
        return found[found["_t"].notna()]

    kinds = StructType([df.schema["symbol"], StructField("bar_id", LongType()), StructField("_t", DoubleType())])
    best = ends.join(starts, key).groupBy(*key).applyInPandas(judged, kinds).groupBy("symbol", "bar_id").agg(F.max("_t").alias("sadf"))
    return df.join(best, ["symbol", "bar_id"], "left").select(*[c for c in df.columns if c != "sadf"], "sadf")


def sadf_signals(df: DataFrame, upper: float = 1.0, lower: float = 1.5) -> DataFrame:
    """1 from where the statistic exceeds ``upper`` until it falls under ``lower``, and the
    log equity of holding while it is on (from the next bar)."""
    def run(g: pd.DataFrame, state: tuple) -> tuple[dict[str, np.ndarray], tuple]:
        on = hysteresis(np.nan_to_num(g["sadf"].to_numpy(float), nan=-np.inf), upper, lower, int(state[0]))
        return {"signal": on}, (on[-1],)

    out = handed_over(df, {"signal": "long"}, run, (0.0,))
    ret = F.log(F.col("close") / F.lag("close").over(by_bar())) * F.lag("signal").over(by_bar())
    total = F.sum(F.coalesce(F.col("strategy_ret"), F.lit(0.0))).over(by_bar().rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("strategy_ret", ret).withColumn("log_equity", total)


def min_max(df: DataFrame, column: str, output: str) -> DataFrame:
    from tickloom.functions.windows import whole

    low, high = whole(F.min, column), whole(F.max, column)
    return df.withColumn(output, F.try_divide(F.col(column) - low, high - low))


