"""DuckDB building blocks of the oracle SQL."""

BARS = """
bars AS (
  SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS BIGINT) AS bar_id, open_time, open, high, low, close, volume
  FROM (SELECT o_orderpriority AS symbol, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS open_time, min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
               min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2))"""

TICKS = """
ticks AS (
  SELECT event_type AS symbol, event_id, ts, value + CAST(1.0 AS DOUBLE) AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty, event_id % 2 = 0 AS is_buyer_maker FROM events)"""

HOURLY = TICKS + """,
hourly AS (
  SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS BIGINT) AS bar_id, open_time, open, high, low, close, volume
  FROM (SELECT symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS open_time, min_by(price, event_id) AS open, max(price) AS high, min(price) AS low,
               max_by(price, event_id) AS close, sum(qty) AS volume FROM ticks GROUP BY 1, 2))"""

BY = "PARTITION BY symbol ORDER BY bar_id"


def rows(n: int) -> str:
    return f"OVER ({BY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rolling(agg: str, x: str, n: int) -> str:
    """An aggregate of the last n rows, null with fewer values."""
    return f"CASE WHEN count({x}) {rows(n)} >= {n} THEN {agg}({x}) {rows(n)} END"


RUNNING = f"OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def ewm(name: str, source: str, x: str, alpha: str) -> str:
    """A recursive table (symbol, bar_id, v): v = alpha*x + (1-alpha)*v from the first bar on."""
    return f"""
{name} AS (
  SELECT symbol, bar_id, CAST({x} AS DOUBLE) AS v FROM {source} WHERE bar_id = 1
  UNION ALL
  SELECT b.symbol, b.bar_id, ({alpha}) * b.{x} + (1 - ({alpha})) * e.v FROM {name} e JOIN {source} b ON b.symbol = e.symbol AND b.bar_id = e.bar_id + 1)"""
