"""Histories that come in pages, as a source of Spark: a page is a partition, and a stream's offset is a time.

A lost task asks for its own page again and for no other. The driver holds page bounds, never rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tickloom.sources.bars import parse_klines

#: Gives the pages (JSON text of kline arrays) of (symbol, timeframe, start_ms, end_ms), the end not included.
Fetch = Callable[[str, str, int, int], Iterator[str]]

SCHEMA = "symbol string, timeframe string, page string"


class Page(InputPartition):
    def __init__(self, symbol: str, timeframe: str, start_ms: int, end_ms: int) -> None:
        super().__init__((symbol, timeframe, start_ms, end_ms))
        self.job = (symbol, timeframe, start_ms, end_ms)


def cut(symbol: str, timeframe: str, start_ms: int, end_ms: int, width: int) -> list[Page]:
    """Pages of at most ``width`` milliseconds that end on its multiples."""
    edges = [start_ms, *range((start_ms // width + 1) * width, end_ms, width), end_ms]
    return [Page(symbol, timeframe, a, b) for a, b in zip(edges, edges[1:]) if a < b]


def page_source(fetch: Fetch, newest: Callable[[], int] | None = None) -> type[DataSource]:
    """A data source named ``pages`` over ``fetch``; ``newest`` gives the time in ms up to which there is data, for streams.

    Options: jobs (JSON list of [symbol, timeframe, start_ms, end_ms]; a stream starts at start_ms and
    ends where end_ms is set) and page_ms (width of a page). A page that can't be fetched fails its task.
    """

    class Reading:
        def __init__(self, options: dict[str, str]) -> None:
            self.jobs, self.width = json.loads(options["jobs"]), int(options.get("page_ms", 86_400_000))
            if self.width < 1:
                raise ValueError("page_ms is at least 1")

        def read(self, partition: Page | None) -> Iterator[tuple[str, str, str]]:
            if partition is None:  # what Spark reads where there are no pages
                return
            for page in fetch(*partition.job):
                yield (*partition.job[:2], page)

    class Batch(Reading, DataSourceReader):
        def partitions(self) -> list[Page]:
            return [p for s, t, a, b in self.jobs for p in cut(s, t, a, b, self.width)]

    class Stream(Reading, DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"ms": min((j[2] for j in self.jobs), default=0)}

        def latestOffset(self) -> dict:
            return {"ms": max(newest(), self.initialOffset()["ms"])}

        def partitions(self, start: dict, end: dict) -> list[Page]:
            each = [(s, t, max(a, start["ms"]), end["ms"] if b is None else min(b, end["ms"])) for s, t, a, b in self.jobs]
            return [p for s, t, a, b in each if a < b for p in cut(s, t, a, b, self.width)]

        def commit(self, end: dict) -> None:
            pass

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "pages"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Batch(self.options)

        def streamReader(self, schema) -> DataSourceStreamReader:
            if newest is None:
                raise ValueError("a stream of pages needs ``newest``")
            return Stream(self.options)

    return Pages


def read_pages(spark: SparkSession, fetch: Fetch, jobs: list[tuple[str, str, int, int]], page_ms: int = 86_400_000) -> DataFrame:
    """Bars of ``jobs`` (columns of ``parse_klines``), fetched a page a task."""
    spark.dataSource.register(page_source(fetch))
    return parse_klines(spark.read.format("pages").option("jobs", json.dumps(jobs)).option("page_ms", page_ms).load())


def stream_pages(spark: SparkSession, fetch: Fetch, newest: Callable[[], int], jobs: list[tuple[str, str, int, int | None]], page_ms: int = 86_400_000) -> DataFrame:
    """A stream of page texts (symbol, timeframe, page) from each job's start on; ``parse_klines`` takes them in each batch."""
    spark.dataSource.register(page_source(fetch, newest))
    return spark.readStream.format("pages").option("jobs", json.dumps(jobs)).option("page_ms", page_ms).load()


def store_pages(bars: DataFrame, timeframe: str, path: str, page_ms: int = 86_400_000) -> None:
    """Bars as a folder of pages (symbol, timeframe, first_ms, page), each of at most ``page_ms``."""
    ms = F.unix_millis(F.col("open_time").cast("timestamp"))
    fields = F.array(*[c.cast("string") for c in (ms, F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.col("volume"), ms, F.lit(0.0), F.lit(0))])
    each = bars.select("symbol", F.lit(timeframe).alias("timeframe"), (F.floor(ms / page_ms) * page_ms).alias("first_ms"), F.struct(ms.alias("ms"), fields.alias("k")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list("line")), lambda x: x["k"])
    each.groupBy("symbol", "timeframe", "first_ms").agg(F.to_json(lines).alias("page")).write.mode("overwrite").parquet(path)


def stored_pages(path: str, page_ms: int = 86_400_000) -> Fetch:
    """Fetches from a folder that ``store_pages`` wrote with this ``page_ms``: all pages that begin in the range."""

    def fetch(symbol: str, timeframe: str, start_ms: int, end_ms: int) -> Iterator[str]:
        import pyarrow.dataset as ds

        first = start_ms // page_ms * page_ms
        wanted = (ds.field("symbol") == symbol) & (ds.field("timeframe") == timeframe) & (ds.field("first_ms") >= first) & (ds.field("first_ms") < end_ms)
        yield from ds.dataset(path, format="parquet").to_table(columns=["page"], filter=wanted)["page"].to_pylist()

    return fetch
