"""Helpers that the text operators share: shared folders, written tables, text slices."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = (np.arange(256) >= 128) | np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123)])
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the tables of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where none is named and all runs in one process, as in local tests, a temporary
    one is made; on a cluster its machines would not see it, so a missing one is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that no later step reads."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that operators use; a null text counts as empty."""
    return df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about ``limit`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
    give_back()


def give_back() -> None:
    """Return freed memory to the system at the end of a task, since Python workers live on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Chunks(NamedTuple):
    """Runs of bytes between white space: ``values`` (string array), byte ``starts`` and
    ``ends`` in the column's joined text, and document ``offsets`` into all three.
    ``begin``: where each document's text starts in the joined text."""

    values: pa.Array
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    begin: np.ndarray


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, back to back, and each row's bounds."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, bounds, data = texts.buffers()
    at = np.frombuffer(bounds, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def runs(raw: np.ndarray, keep: np.ndarray, begin: np.ndarray, cuts: np.ndarray | None = None) -> Chunks:
    """The longest runs of kept bytes that stay inside a document and between ``cuts``."""
    edge = np.zeros(len(raw) + 1, bool)
    edge[begin] = True
    if cuts is not None:
        edge[cuts] = True
    starts = np.flatnonzero(keep & (edge[:-1] | ~np.concatenate([[False], keep[:-1]])))
    ends = np.flatnonzero(keep & (edge[1:] | ~np.concatenate([keep[1:], [False]]))) + 1
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    values = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(raw[keep]))
    return Chunks(values, starts, ends, np.searchsorted(starts, begin), begin)


def spaced(texts: pa.Array) -> Chunks:
    """Chunks between ASCII white space (space and 9 to 13) of each text."""
    raw, begin = joined(texts)
    return runs(raw, ~SPACE[raw], begin)


def tokenizer_chunks(texts: pa.Array) -> Chunks:
    """Chunks between white space, A-Z in lower case, with a comma or full stop that ends a
    chunk after an ASCII letter on its own.

    For a tokenizer that lower-cases and starts a token at such a mark, their ids are
    those of the text. Slices with "<|" keep their case, since that may begin a special token.
    """
    raw, begin = joined(texts)
    keep = ~SPACE[raw]
    marks = np.flatnonzero((raw == 44) | (raw == 46))
    last = np.zeros(len(raw) + 1, bool)
    last[begin] = True
    last[:-1] |= ~keep
    marks = marks[(marks > 0) & last[marks + 1]]
    marks = marks[_LETTER[raw[marks - 1]] & ~last[marks]]
    if not ((raw[:-1] == 60) & (raw[1:] == 124)).any():
        raw = _LOWER[raw]
    return runs(raw, keep, begin, marks)


def lowered_words(texts: pa.Array) -> tuple[np.ndarray, Chunks]:
    """Lower-cased (A-Z) bytes of each text and its runs of letters, digits and non-ASCII bytes."""
    raw, begin = joined(texts)
    raw = _LOWER[raw]
    return raw, runs(raw, _WORD[raw], begin)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
