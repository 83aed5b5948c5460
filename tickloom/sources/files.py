"""Many files at once, results as files, and histories fetched by tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.bars import load_bars, parse_klines, read_ohlcv, save_bars, with_bar_id

#: Format of a file by its suffix (fixed values).
FORMATS = {"csv": "csv", "json": "json", "parquet": "parquet"}


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_folder(spark: SparkSession, root: str, timeframe: str, symbols: list[str] | None = None, file_format: str = "parquet", start: str | None = None, end: str | None = None, normalize: bool = True) -> DataFrame:
    """Bars of one timeframe: files ``root/timeframe/symbol.format``, in one scan.

    Symbols without a file are left out; files that can't be read are skipped. A missing
    folder, or no file at all, is an error.
    """
    folder = f"{root}/{timeframe}"
    if not _exists(spark, folder):
        raise ValueError(f"no folder {folder}")
    paths = [f"{folder}/*.{file_format}"] if symbols is None else [p for p in (f"{folder}/{s}.{file_format}" for s in symbols) if _exists(spark, p)]
    if not paths:
        raise ValueError(f"no files for {symbols} in {folder}")
    return read_ohlcv(spark, paths, file_format, start=start, end=end, normalize=normalize, skip_bad=True).withColumn("timeframe", F.lit(timeframe))


def read_timeframes(spark: SparkSession, root: str, timeframes: list[str], symbols: list[str] | None = None, file_format: str = "parquet", start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of several timeframes under one another; timeframes without a folder are left out."""
    out = None
    for t in timeframes:
        if _exists(spark, f"{root}/{t}"):
            one = read_folder(spark, root, t, symbols, file_format, start, end)
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no folder of {timeframes} in {root}")
    return out


def save_table(table: DataFrame, path: str, overwrite: bool = True) -> None:
    """Write a table as CSV, JSON lines or Parquet, by the suffix of the path."""
    kind = FORMATS.get(path.rsplit(".", 1)[-1].lower())
    if kind is None:
        raise ValueError(f"unknown suffix of {path}; one of {sorted(FORMATS)}")
    if kind == "csv":  # nested columns have no form in CSV
        table = table.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in table.dtypes])
    table.write.mode("overwrite" if overwrite else "errorifexists").format(kind).option("header", True).save(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``save_table`` wrote; CSV columns get the narrowest kind that fits."""
    kind = FORMATS.get(path.rsplit(".", 1)[-1].lower())
    if kind is None:
        raise ValueError(f"unknown suffix of {path}; one of {sorted(FORMATS)}")
    return spark.read.format(kind).options(header=True, inferSchema=True).load(path)


def save_nested(results: DataFrame, path: str) -> None:
    """Each row as one JSON document (column ``value``), as evaluation results are kept."""
    results.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def fetch_history(jobs: DataFrame, fetch: Callable[[str, str, int, int], Iterator[str]]) -> DataFrame:
    """Bars that tasks fetch, one job (symbol, timeframe, start_ms, end_ms) at a time.

    ``fetch`` yields pages (JSON text of kline arrays) of one job; each job is a task of
    its own, so that a lost one fetches again. Columns of ``parse_klines``; jobs that fail
    leave a row in ``failed_jobs`` instead.
    """
    pages = _pages(jobs, fetch)
    return parse_klines(pages.where("error IS NULL").select("symbol", "timeframe", "page"))


def failed_jobs(jobs: DataFrame, fetch: Callable[[str, str, int, int], Iterator[str]]) -> DataFrame:
    """Jobs whose fetching fails, with the error."""
    return _pages(jobs, fetch).where("error IS NOT NULL").select("symbol", "timeframe", "error")


def _pages(jobs: DataFrame, fetch: Callable[[str, str, int, int], Iterator[str]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for job in batch.itertuples(index=False):
                try:
                    for page in fetch(job.symbol, job.timeframe, int(job.start_ms), int(job.end_ms)):
                        yield pd.DataFrame([(job.symbol, job.timeframe, page, None)], columns=["symbol", "timeframe", "page", "error"])
                except Exception as e:  # a job's failure is a result, the others go on
                    yield pd.DataFrame([(job.symbol, job.timeframe, None, f"{type(e).__name__}: {e}")], columns=["symbol", "timeframe", "page", "error"])

    dealt = jobs.repartition("symbol", "timeframe")
    return dealt.mapInPandas(run, "symbol string, timeframe string, page string, error string")


def download(jobs: DataFrame, fetch: Callable[[str, str, int, int], Iterator[str]], path: str, overwrite: bool = False) -> None:
    """Fetch histories and write them by timeframe and symbol; what is there stays unless ``overwrite``."""
    save_bars(fetch_history(jobs, fetch), path, overwrite)


def load_history(spark: SparkSession, path: str, symbol: str | None = None, timeframe: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Numbered bars of a written history; all conditions reach the scan."""
    bars = load_bars(spark, path, symbol, timeframe)
    for cond, value in ((">=", start), ("<=", end)):
        bars = bars.where(f"open_time {cond} TIMESTAMP_NTZ '{value}'") if value else bars
    return with_bar_id(bars)
