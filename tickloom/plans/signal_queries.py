"""Queries of filters, bubble tests and level finders."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tickloom.operators import filters as flt
from tickloom.operators import levels as lev
from tickloom.plans import sql as q
from tickloom.plans.queries import ORACLES, daily, hourly, on_bars, r, register
from tickloom.sources import bars as src

_KALMAN = "k AS (SELECT symbol, bar_id, close AS v, 1.0::DOUBLE - 1.0::DOUBLE / (1.0::DOUBLE + 0.1::DOUBLE) AS p FROM bars WHERE bar_id = 1 UNION ALL SELECT b.symbol, b.bar_id, k.v + (k.p + 0.01::DOUBLE) / (k.p + 0.01::DOUBLE + 0.1::DOUBLE) * (b.close - k.v), (k.p + 0.01::DOUBLE) * (1 - (k.p + 0.01::DOUBLE) / (k.p + 0.01::DOUBLE + 0.1::DOUBLE)) FROM k JOIN bars b ON b.symbol = k.symbol AND b.bar_id = k.bar_id + 1)"
on_bars(
    "flt_kalman", {"kalman": 4}, flt.kalman_filter,
    f"{_KALMAN}, o AS (SELECT symbol, bar_id, v AS kalman FROM k)",
)
# a quadratic fit over 11 points, by polynomials orthogonal over -5..5: 1, t and t*t - 10
_SG = "sum(w.close * (1 / 11.0::DOUBLE + s * t / 110.0::DOUBLE + (s * s - 10) * (t * t - 10) / 858.0::DOUBLE))"
on_bars(
    "flt_savgol", {"savgol": 3}, flt.savitzky_golay,
    f"""sz AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars), ce AS (SELECT *, least(greatest(bar_id, 6), n - 5) AS middle FROM sz),
    sg AS (SELECT symbol, bar_id, {_SG} AS savgol FROM (SELECT c.symbol, c.bar_id, w.close, c.bar_id - c.middle AS s, w.bar_id - c.middle AS t FROM ce c JOIN bars w ON w.symbol = c.symbol AND w.bar_id BETWEEN c.middle - 5 AND c.middle + 5 WHERE c.n >= 11) w GROUP BY 1, 2),
    o AS (SELECT symbol, bar_id, savgol FROM ce LEFT JOIN sg USING (symbol, bar_id))""",
)
# forward and backward substitution in the band of I + 1600 K'K, K second differences
_L = "1600.0::DOUBLE"
on_bars(
    "flt_hp", {"trend": 2, "cycle": 2}, flt.hodrick_prescott,
    f"""hn AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
    hm AS (SELECT *, 1 + {_L} * CASE WHEN bar_id IN (1, n) THEN 1 WHEN bar_id IN (2, n - 1) THEN 5 ELSE 6 END AS dd, {_L} * CASE WHEN bar_id IN (1, n - 1) THEN -2 ELSE -4 END AS ee FROM hn),
    fw AS (SELECT symbol, bar_id, n, close, dd AS d, ee AS e, close AS y, 1e300::DOUBLE AS d1, 0.0::DOUBLE AS y1 FROM hm WHERE bar_id = 1
      UNION ALL SELECT h.symbol, h.bar_id, h.n, h.close, h.dd - f.e * f.e / f.d - {_L} * {_L} / f.d1, h.ee - f.e * {_L} / f.d, h.close - f.e / f.d * f.y - {_L} / f.d1 * f.y1, f.d, f.y FROM fw f JOIN hm h ON h.symbol = f.symbol AND h.bar_id = f.bar_id + 1),
    bw AS (SELECT symbol, bar_id, close, y / d AS t, 0.0::DOUBLE AS t1 FROM fw WHERE bar_id = n
      UNION ALL SELECT f.symbol, f.bar_id, f.close, (f.y - f.e * b.t - {_L} * b.t1) / f.d, b.t FROM bw b JOIN fw f ON f.symbol = b.symbol AND f.bar_id = b.bar_id - 1),
    o AS (SELECT symbol, bar_id, t AS trend, close - t AS cycle FROM bw)""",
)


def _butter_sql() -> str:
    """The low pass of order 3 at a tenth of half the rate, by its states, over 12 more values at both ends."""
    k = math.tan(math.pi * 0.1 / 2)
    p, den = (k - 1) / (k + 1), k * k + k + 1
    q1, q2 = 2 * (k * k - 1) / den, (k * k - k + 1) / den
    b, a = [k**3 / ((k + 1) * den) * w for w in (1, 3, 3, 1)], [1.0, p + q1, q2 + p * q1, p * q2]
    lit = lambda v: f"{v!r}::DOUBLE"

    def steps(name: str, source: str, ascending: bool) -> str:
        y = f"({lit(b[0])} * s.x + c.z1)"
        rest = ", ".join(f"x * {lit(sum(b[i:]) - sum(a[i:]))} AS z{i}" for i in (1, 2, 3))
        first, after = ("i = 1", "c.i + 1") if ascending else ("i = n", "c.i - 1")
        seed = f"SELECT symbol, {'0' if ascending else 'n + 1'} AS i, 0.0::DOUBLE AS y, {rest} FROM {source} WHERE {first}"
        new = ", ".join(f"{lit(b[i])} * s.x - {lit(a[i])} * {y} + {'c.z%d' % (i + 1) if i < 3 else '0'}" for i in (1, 2, 3))
        return f"{name} AS ({seed} UNION ALL SELECT s.symbol, s.i, {y}, {new} FROM {name} c JOIN {source} s ON s.symbol = c.symbol AND s.i = {after})"

    return f"""bn AS (SELECT symbol, bar_id, close, count(*) OVER (PARTITION BY symbol) AS n, first_value(close) OVER w AS head, last_value(close) OVER w AS tail FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    lg AS (SELECT symbol, bar_id + 12 AS i, n + 24 AS n, close AS x FROM bn UNION ALL SELECT symbol, 14 - bar_id, n + 24, 2 * head - close FROM bn WHERE bar_id BETWEEN 2 AND 13 UNION ALL SELECT symbol, 2 * n - bar_id + 12, n + 24, 2 * tail - close FROM bn WHERE bar_id BETWEEN n - 12 AND n - 1),
    {steps("go", "lg", True)}, gn AS (SELECT symbol, i, n, go.y AS x FROM go JOIN lg USING (symbol, i)), {steps("ba", "gn", False)},
    o AS (SELECT bn.symbol, bar_id, y AS butter FROM bn JOIN ba ON ba.symbol = bn.symbol AND ba.i = bar_id + 12)"""


on_bars("flt_butter", {"butter": 3}, flt.butterworth, _butter_sql())
# three Haar steps: sums and differences of pairs, the last of an odd number with itself
_PAIR = "SELECT symbol, i // 2 AS i, (min_by({x}, i) + max_by({x}, i)) / sqrt(2) AS a, (min_by({x}, i) - max_by({x}, i)) / sqrt(2) AS d FROM {t} GROUP BY 1, 2"
_HAAR = f"""h0 AS (SELECT symbol, bar_id - 1 AS i, close AS a, count(*) OVER (PARTITION BY symbol) AS n FROM bars), h1 AS ({_PAIR.format(x="a", t="h0")}), h2 AS ({_PAIR.format(x="a", t="h1")}), h3 AS ({_PAIR.format(x="a", t="h2")})"""


def _haar_back(part1: str, part2: str, part3: str) -> str:
    """Tables r2, r1 and wv (symbol, i, v): the series of three steps with these details in place of d."""
    up = lambda own, above, value, part: f"SELECT f.symbol, f.i, ({value} + CASE WHEN f.i % 2 = 0 THEN 1 ELSE -1 END * {part}) / sqrt(2) AS v FROM {own} f JOIN {above} ON g.symbol = f.symbol AND g.i = f.i // 2"
    return f"""r2 AS ({up("h2", "h3 g", "g.a", part3)}), r1 AS ({up("h1", "(SELECT r2.*, d FROM r2 JOIN h2 USING (symbol, i)) g", "g.v", part2)}), wv AS ({up("h0", "(SELECT r1.*, d FROM r1 JOIN h1 USING (symbol, i)) g", "g.v", part1)})"""


_SHRUNK = "sign(g.d) * greatest(abs(g.d) - (SELECT lim FROM lm WHERE lm.symbol = f.symbol), 0)"
_WAVELET = f"""{_HAAR}, lm AS (SELECT symbol, median(abs(d)) / 0.6745::DOUBLE * sqrt(2 * ln((SELECT any_value(n) FROM h0 WHERE h0.symbol = h1.symbol))) AS lim FROM h1 GROUP BY symbol), {_haar_back(_SHRUNK, _SHRUNK, _SHRUNK)}"""
on_bars("flt_wavelet", {"wavelet": 6}, flt.wavelet, f"{_WAVELET}, o AS (SELECT symbol, i + 1 AS bar_id, v AS wavelet FROM wv)")
on_bars("flt_wavelet_levels", {"wavelet_part": 6}, lambda b: flt.wavelet_levels(b, [0, 3]), f"{_HAAR}, {_haar_back('0', '0', 'g.d')}, o AS (SELECT symbol, i + 1 AS bar_id, v AS wavelet_part FROM wv)")
on_bars(
    "flt_ensemble", {"ensemble": 6}, lambda b: flt.ensemble(flt.wavelet(flt.kalman_filter(b)), {"kalman": 2.0, "wavelet": 1.0}),
    f"{_KALMAN}, {_WAVELET}, o AS (SELECT k.symbol, bar_id, (2 * k.v + wv.v) / 3 AS ensemble FROM k JOIN wv ON wv.symbol = k.symbol AND wv.i = bar_id - 1)",
)


def _sadf(value: str) -> str:
    """Oracle tables up to ``sd``: the statistic from sums over every span of 30 moves or more."""
    sums = ", ".join(f"sum({x}) OVER w AS {n}" for n, x in {"cy": "y", "cd": "d", "cyy": "y * y", "cyd": "y * d", "cdd": "d * d"}.items())
    parts = ", ".join(f"b.{n} - coalesce(a.{n}, 0) AS {n}" for n in ("cy", "cd", "cyy", "cyd", "cdd"))
    return f"""{q.HOURLY}, va AS (SELECT *, {value} AS v FROM hourly), mv AS (SELECT symbol, bar_id, close, lag(v) OVER ({q.BY}) - first_value(v) OVER ({q.BY}) AS y, v - lag(v) OVER ({q.BY}) AS d FROM va),
    cu AS (SELECT symbol, bar_id, close, {sums} FROM mv WINDOW w AS ({q.BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    sp AS (SELECT b.symbol, b.bar_id, b.bar_id - a.bar_id AS n, {parts} FROM cu b JOIN cu a ON a.symbol = b.symbol AND b.bar_id - a.bar_id >= 30),
    st AS (SELECT symbol, bar_id, n, cyy - cy * cy / n AS vy, cyd - cy * cd / n AS cv, cdd - cd * cd / n AS vd FROM sp),
    tt AS (SELECT symbol, bar_id, max(t) AS sadf FROM (SELECT *, cv / vy / nullif(sqrt(greatest(vd - cv / vy * cv, 0) / (n - 2) / vy), 0) AS t FROM st WHERE vy > 0) WHERE isfinite(t) GROUP BY 1, 2),
    sd AS (SELECT symbol, bar_id, close, sadf FROM cu LEFT JOIN tt USING (symbol, bar_id))"""


register("sadf", lambda s, d: flt.sadf(hourly(s, d).withColumn("close", F.log("close"))).select("symbol", "bar_id", r("sadf", 4)), f"WITH {_sadf('ln(close)')} SELECT symbol, bar_id, round(sadf, 4) + 0.0 AS sadf FROM sd")
register(
    "sadf_signals", lambda s, d: flt.sadf_signals(flt.sadf(hourly(s, d))).select("symbol", "bar_id", "signal", r("log_equity", 6)),
    f"""WITH RECURSIVE {_sadf('close')}, hy AS (SELECT symbol, bar_id, CASE WHEN coalesce(sadf > 1.0, false) THEN 1 ELSE 0 END AS signal FROM sd WHERE bar_id = 1
      UNION ALL SELECT s.symbol, s.bar_id, CASE WHEN h.signal = 0 AND coalesce(s.sadf > 1.0, false) THEN 1 WHEN h.signal = 1 AND coalesce(s.sadf < 1.5, true) THEN 0 ELSE h.signal END FROM hy h JOIN sd s ON s.symbol = h.symbol AND s.bar_id = h.bar_id + 1),
    rt AS (SELECT symbol, bar_id, signal, ln(close / lag(close) OVER ({q.BY})) * lag(signal) OVER ({q.BY}) AS x FROM hy JOIN sd USING (symbol, bar_id))
    SELECT symbol, bar_id, CAST(signal AS BIGINT) AS signal, round(sum(coalesce(x, 0)) {q.RUNNING}, 6) + 0.0 AS log_equity FROM rt""",
)

register(
    "volume_profile", lambda s, d: lev.volume_profile(hourly(s, d)).select("symbol", "bin", r("price", 8), r("volume", 6), "poc", "high_volume", "value_area"),
    f"""WITH {q.HOURLY}, lb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_id DESC) AS back FROM hourly) WHERE back <= 100), sp AS (SELECT symbol, min(low) AS lo, max(high) AS hi FROM lb GROUP BY 1),
    ed AS (SELECT lb.*, lo, (hi - lo) / 80 AS width FROM lb JOIN sp USING (symbol)), bb AS (SELECT *, greatest(CAST(ceil((low - lo) / width - 0.5) AS BIGINT), 0) AS b0, least(CAST(floor((high - lo) / width - 0.5) AS BIGINT), 79) AS b1 FROM ed WHERE width > 0),
    ex AS (SELECT *, unnest(range(b0, b1 + 1)) AS bin, volume / (b1 - b0 + 1) AS part FROM bb WHERE b0 <= b1), pr AS (SELECT symbol, bin, any_value(lo) + (bin + 0.5) * any_value(width) AS price, sum(part) AS volume FROM ex GROUP BY 1, 2),
    ra AS (SELECT *, row_number() OVER w AS rn, sum(volume) OVER (PARTITION BY symbol ORDER BY volume DESC, bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(volume) OVER (PARTITION BY symbol) AS total, quantile_cont(volume, 0.7) OVER (PARTITION BY symbol) AS p70 FROM pr WINDOW w AS (PARTITION BY symbol ORDER BY volume DESC, bin))
    SELECT symbol, bin, round(price, 8) + 0.0 AS price, round(volume, 6) + 0.0 AS volume, rn = 1 AS poc, volume >= p70 AS high_volume, before IS NULL OR before < 0.7 * total AS value_area FROM ra""",
)
register("volume_profile_levels", lambda s, d: lev.profile_levels(lev.volume_profile(hourly(s, d))).select("symbol", "side", "rank", r("price", 6), r("volume", 6)), ORACLES["volume_profile"].split("SELECT symbol, bin, round(price, 8)")[0] + """, lc AS (SELECT symbol, max_by(close, bar_id) AS last_close FROM lb GROUP BY 1), sd AS (SELECT ra.*, CASE WHEN price < last_close THEN 'support' ELSE 'resistance' END AS side FROM ra JOIN lc USING (symbol) WHERE volume >= p70),
    rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY volume DESC, bin) AS rank FROM sd) SELECT symbol, side, CAST(rank AS INT) AS rank, round(price, 6) + 0.0 AS price, round(volume, 6) + 0.0 AS volume FROM rk WHERE rank <= 3""")


def _mtf(s, d):
    frames = {"1h": (F.col("open_time"), 1.0), "4h": (src.hours_bucket(4), 2.0), "1d": (F.date_trunc("day", "open_time"), 3.0)}
    return lev.multi_timeframe_levels(hourly(s, d), frames).select("symbol", "side", "cluster", r("price", 6), "touches", r("score", 6), "major")


_FRAMES = {"1h": ("open_time", 1.0), "4h": ("CAST(time_bucket(INTERVAL 4 HOUR, open_time, TIMESTAMP '2000-01-01') AS TIMESTAMP)", 2.0), "1d": ("CAST(date_trunc('day', open_time) AS TIMESTAMP)", 3.0)}
_RES = " UNION ALL ".join(f"SELECT symbol, '{n}' AS timeframe, {w}::DOUBLE AS weight, {b} AS open_time, min_by(open, bar_id) AS open, max(high) AS high, min(low) AS low, max_by(close, bar_id) AS close, sum(volume) AS volume FROM hourly GROUP BY ALL" for n, (b, w) in _FRAMES.items())
register(
    "mtf_levels", _mtf,
    f"""WITH RECURSIVE {q.HOURLY}, rs AS ({_RES}), nm AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol, timeframe) AS n, coalesce(lag(close) OVER w, open) AS pc FROM rs WINDOW w AS (PARTITION BY symbol, timeframe ORDER BY open_time)),
    tr AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM nm), wr AS (
      SELECT symbol, timeframe, i, avg(tr) FILTER (i <= 14) OVER (PARTITION BY symbol, timeframe) AS v FROM tr QUALIFY i <= 14
      UNION ALL SELECT a.symbol, a.timeframe, t.i, (a.v * 13 + t.tr) / 14 FROM wr a JOIN tr t ON t.symbol = a.symbol AND t.timeframe = a.timeframe AND t.i = a.i + 1 WHERE t.i > 14 AND a.i >= 14),
    rc AS (SELECT tr.*, greatest(2, trunc(v / (close * 0.001))::BIGINT) AS reach FROM tr JOIN wr USING (symbol, timeframe, i)),
    bt AS (SELECT a.symbol, a.timeframe, a.i, bool_or(b.high >= a.high) AS over_, bool_or(b.low <= a.low) AS under_ FROM rc a JOIN rc b ON b.symbol = a.symbol AND b.timeframe = a.timeframe AND b.i <> a.i AND b.i BETWEEN a.i - a.reach AND a.i + a.reach GROUP BY ALL),
    pt AS (SELECT rc.*, NOT over_ AS top, NOT under_ AS bottom FROM rc JOIN bt USING (symbol, timeframe, i) WHERE i > 2 AND i <= n - 2),
    pv AS (SELECT symbol, 'resistance' AS side, open_time, weight, high AS price, volume FROM pt WHERE top UNION ALL SELECT symbol, 'support', open_time, weight, low, volume FROM pt WHERE bottom),
    gp AS (SELECT *, coalesce((price - lag(price) OVER w > 0.005::DOUBLE * avg(price) OVER (PARTITION BY symbol, side))::INT, 0) AS gap FROM pv WINDOW w AS (PARTITION BY symbol, side ORDER BY price, open_time)),
    cl AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY symbol, side ORDER BY price, open_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cluster FROM gp),
    la AS (SELECT *, max(open_time) OVER (PARTITION BY symbol, side, cluster) AS last_time FROM cl),
    sc AS (SELECT symbol, side, cluster, coalesce(sum(price * volume) / nullif(sum(volume), 0), avg(price)) AS price, count(*) AS touches, (count(*) + sum(weight) + CASE WHEN sum(volume) > 0 THEN count(*) ELSE 0 END) * avg(exp(-floor(epoch(last_time - open_time) / 86400) / 30.0::DOUBLE)) AS score FROM la GROUP BY ALL HAVING count(*) >= 2)
    SELECT symbol, side, cluster, round(price, 6) + 0.0 AS price, touches, round(score, 6) + 0.0 AS score, score >= 5 AS major FROM sc""",
)
