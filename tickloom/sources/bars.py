"""Bar and tick tables: derivation from other tables, file readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Names under which files may hold the columns of a bar, lower case (fixed values).
ALIASES = {"open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume", "vol": "volume", "adj close": "close"}
#: Names under which files may hold the time of a bar (fixed values).
TIME_COLUMNS = ["date", "datetime", "timestamp", "time", "opentime", "open_time"]
#: Formats that times are tried in after the default (fixed values).
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd"]
#: Folder of each timeframe below a root (fixed values).
TIMEFRAME_MINUTES = {"m": 1, "h": 60, "d": 1440, "w": 10080}


def with_bar_id(bars: DataFrame, start_id: int = 1) -> DataFrame:
    """Number the bars of each symbol by time."""
    order = Window.partitionBy("symbol").orderBy("open_time")
    return bars.withColumn("bar_id", (F.row_number().over(order) + (start_id - 1)).cast("long"))


def bars_from(rows: DataFrame, symbol: Column, bucket: Column, price: Column, seq: Column, volume: Column) -> DataFrame:
    """Bars of rows by symbol and time bucket; ``seq`` orders rows inside a bucket.

    One partial and one final aggregation; the numbering reuses the shuffle by symbol.
    """
    grouped = rows.groupBy(symbol.alias("symbol"), bucket.cast("timestamp_ntz").alias("open_time")).agg(
        F.min_by(price, seq).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, seq).alias("close"), volume.cast("double").alias("volume")
    )
    return with_bar_id(grouped).select("symbol", "bar_id", "open_time", "open", "high", "low", "close", "volume")


def daily_bars(orders: DataFrame) -> DataFrame:
    """Daily bars of order prices, one symbol per priority."""
    return bars_from(orders, F.col("o_orderpriority"), F.date_trunc("day", "o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"), F.count("*"))


def ticks_from(events: DataFrame) -> DataFrame:
    """One tick per event: symbol, event_id, ts, price, qty, is_buyer_maker."""
    return events.select(
        F.col("event_type").alias("symbol"), "event_id", "ts", (F.col("value") + F.lit(1.0)).alias("price"), F.get_json_object("props", "$.k").cast("double").alias("qty"), (F.col("event_id") % 2 == 0).alias("is_buyer_maker")
    )


def hourly_bars(events: DataFrame) -> DataFrame:
    """Hourly bars of event values, one symbol per event type."""
    t = ticks_from(events)
    return bars_from(t, F.col("symbol"), F.date_trunc("hour", "ts"), F.col("price"), F.col("event_id"), F.sum("qty"))


def resample(bars: DataFrame, bucket: Column) -> DataFrame:
    """Coarser bars; buckets without bars do not appear."""
    grouped = bars.groupBy("symbol", bucket.cast("timestamp_ntz").alias("open_time")).agg(
        F.min_by("open", "bar_id").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_id").alias("close"), F.sum("volume").alias("volume")
    )
    return with_bar_id(grouped).select("symbol", "bar_id", "open_time", "open", "high", "low", "close", "volume")


def hours_bucket(n: int) -> Column:
    """The n-hour bucket of open_time, counted from midnight."""
    t = F.col("open_time")
    return F.date_trunc("day", t) + F.make_dt_interval(F.lit(0), (F.floor(F.hour(t) / n) * n).cast("int"))


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename price and volume columns whatever their case; other columns stay."""
    return df.select(*[F.col(f"`{c}`").alias(ALIASES.get(c.lower(), c)) for c in df.columns])


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def _time_column(df: DataFrame, named: str | None) -> str:
    by_lower = {c.lower(): c for c in df.columns}
    for c in [named.lower()] if named else TIME_COLUMNS:
        if c in by_lower:
            return by_lower[c]
    raise ValueError("no time column")


def _parsed(column: Column) -> Column:
    """The time of a text in any known format; a text in none of them is an error, never a null."""
    found = F.coalesce(*[F.try_to_timestamp(column, F.lit(f)) for f in TIME_FORMATS], F.try_to_timestamp(column)).cast("timestamp_ntz")
    return F.when(column.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("not a time: "), column)).cast("timestamp_ntz"))


def _finish(df: DataFrame, time: str, normalize: bool) -> DataFrame:
    out = normalize_columns(df) if normalize else df
    out = require(out, ["open", "high", "low", "close"] if normalize else [])
    kind = dict(df.dtypes)[time]
    stamp = F.col(f"`{time}`").cast("timestamp_ntz") if kind.startswith("timestamp") or kind == "date" else _parsed(F.col(f"`{time}`").cast("string"))
    prices = [F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume") if c in out.columns]
    return out.select("symbol", stamp.alias("open_time"), *prices)


def read_ohlcv(spark: SparkSession, paths: list[str] | str, file_format: str = "parquet", date_column: str | None = None, normalize: bool = True, start: str | None = None, end: str | None = None, skip_bad: bool = False) -> DataFrame:
    """Numbered bars from files; the symbol is the file's name before its suffix.

    ``start`` and ``end`` bound open_time, both included. ``skip_bad``: leave out files
    that are gone or can't be read, instead of failing.
    """
    reader = spark.read.option("header", True) if file_format == "csv" else spark.read
    reader = reader.options(ignoreCorruptFiles=skip_bad, ignoreMissingFiles=skip_bad)
    raw = reader.format(file_format).load(paths)
    time = _time_column(raw, date_column)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^/.]+)?$", 1)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)\.(?:parquet|csv)/[^/]+$", 1)
    bars = _finish(raw.withColumn("symbol", F.when(folder != "", folder).otherwise(stem)) if "symbol" not in raw.columns else raw, time, normalize)
    if start:
        bars = bars.where(F.col("open_time") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        bars = bars.where(F.col("open_time") <= F.lit(end).cast("timestamp_ntz"))
    return with_bar_id(bars)


def parse_klines(pages: DataFrame, column: str = "page") -> DataFrame:
    """Bars from pages of kline arrays (JSON text), as a market's REST interface sends them.

    ``pages`` has symbol, timeframe and the page. Fields by place: open time (ms), open,
    high, low, close, volume, close time, quote volume, trades.
    """
    rows = pages.select("symbol", "timeframe", F.explode(F.from_json(column, "array<array<string>>")).alias("k"))
    num = lambda i, kind: F.get("k", F.lit(i)).cast(kind)
    return rows.select(
        "symbol", "timeframe", F.timestamp_millis(num(0, "long")).cast("timestamp_ntz").alias("open_time"), *[num(i, "float").alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)], num(7, "float").alias("quote_volume"), num(8, "int").alias("number_of_trades")
    ).dropDuplicates(["symbol", "timeframe", "open_time"])


def save_bars(bars: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write bars by timeframe and symbol. What is there of the same timeframe and symbol stays, or gives way with
    ``overwrite``; other series stay in both cases. No bars write nothing."""
    spark = bars.sparkSession
    if overwrite:
        out = bars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        if _holds_bars(spark, path):
            # one row for each series, from the names of folders and the counts in the files' footers
            bars = bars.join(load_bars(spark, path).select("timeframe", "symbol").distinct(), ["timeframe", "symbol"], "left_anti")
        out = bars.write.mode("append")
    out.partitionBy("timeframe", "symbol").parquet(path)


def _holds_bars(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/timeframe=*/symbol=*")
    return bool(found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found))


def load_bars(spark: SparkSession, path: str, symbol: str | None = None, timeframe: str | None = None) -> DataFrame:
    """Bars that ``save_bars`` wrote; the conditions prune partitions."""
    # symbols and timeframes stay text, even where all of them look like numbers
    text = {"symbol", "timeframe"}
    kinds = StructType([StructField(f.name, StringType()) if f.name in text else f for f in spark.read.parquet(path).schema])
    bars = spark.read.schema(kinds).parquet(path)
    for c, v in (("symbol", symbol), ("timeframe", timeframe)):
        bars = bars.where(F.col(c) == v) if v else bars
    return bars


def available_symbols(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct().orderBy("symbol")


def data_info(bars: DataFrame) -> DataFrame:
    """First and last time, number of bars and of columns by symbol."""
    return bars.groupBy("symbol").agg(F.min("open_time").alias("start_time"), F.max("open_time").alias("end_time"), F.count("*").alias("n_bars")).withColumn("n_columns", F.lit(len(bars.columns)))


def stored_size(spark: SparkSession, path: str) -> DataFrame:
    """Bytes and number of the files below a path, by their folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder")).agg(F.sum("length").alias("n_bytes"), F.count("*").alias("n_files"))


def timeframe_minutes(timeframe: str) -> int:
    """Minutes of a timeframe such as 15m, 4h, 1d or 1w."""
    unit = TIMEFRAME_MINUTES.get(timeframe[-1:].lower())
    if not unit or not timeframe[:-1].isdigit():
        raise ValueError(f"unknown timeframe {timeframe!r}")
    return int(timeframe[:-1]) * unit


def estimate_download_seconds(symbols: int, days: int, timeframe: str, workers: int = 8, per_request: int = 1000, delay: float = 0.5) -> float:
    """Seconds that fetching a history takes at a fixed delay per request."""
    candles = days * 1440 // timeframe_minutes(timeframe)
    return max(1, candles // per_request) * symbols * delay / workers


#: Quote assets that have a category of their own (fixed values).
QUOTES = ["USDT", "BTC", "ETH", "BNB", "BUSD", "USDC"]


def trading(symbols: DataFrame, status: str = "TRADING", column: str = "status") -> DataFrame:
    """Symbols of a status, in upper case."""
    return symbols.where(F.upper(column) == status).withColumn("symbol", F.upper("symbol"))


def keep_listed(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """The wanted symbols that a catalog lists, in the order asked for (columns symbol, place)."""
    return wanted.join(listed.select("symbol"), "symbol", "left_semi").orderBy("place")


def categorize(symbols: DataFrame, quote: str = "quote_asset") -> DataFrame:
    """Category of each market symbol by its quote asset."""
    return symbols.withColumn("category", F.when(F.col(quote).isin(QUOTES), F.concat(F.col(quote), F.lit("_PAIR"))).otherwise("OTHER"))


def symbol_statistics(symbols: DataFrame, by: str) -> DataFrame:
    """Number of symbols per value of a column."""
    return symbols.groupBy(F.col(by).alias("value")).agg(F.count("*").alias("n_symbols"))
