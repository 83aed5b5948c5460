"""Token-id shards with a minimal perfect hash index over document keys.

A store is a folder of two Parquet tables:

``segments``  one row per segment: shard, segment, n_ids, keys, lengths and the
              ids of its documents back to back as raw little-endian integers
              (two bytes each where the vocabulary allows, else four).
``index``     one row per bucket of keys: the bit levels of a minimal perfect
              hash and, in slot order, fingerprints and places of its keys.

Documents lie in ascending key order over shards, segments and places. Parquet
is the container so that Spark's own committer makes lost tasks harmless and so
that any file system that Spark can reach will do.

Rows that repeat a key are all stored, one after another; the index gives the
first of them and their number. Rows with a null key are stored first and have
no index entry. A null text is empty. Extra columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm import wordtokens
from tickloom.llm.common import documents, mix64, slices

#: Ids after which a segment ends (a longer document is a segment of its own).
SEGMENT_IDS = 1 << 20
#: Keys that a bucket of the index holds on average.
BUCKET_KEYS = 20_000
#: Slots per key of each bit level.
GAMMA = 1.5

_SEGMENTS = "shard int, segment int, width int, n_ids long, keys array<long>, lengths array<int>, payload binary"
_INDEX = "bucket long, n_keys int, levels array<binary>, sizes array<int>, fingerprint binary, shard binary, segment binary, place binary, start binary, n_ids binary, copies binary"
_PLACES = "key long, shard int, segment int, place int, start long, n_ids int, copies int"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, key: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts and write a store at ``path`` (in a folder all machines share)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, segment = wordtokens.load(tokenizer), TaskContext.get().partitionId(), 0
        keys, lengths, parts, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            payload = b"".join(parts)
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "segment": segment, "width": own.dtype.itemsize, "n_ids": held, "keys": keys, "lengths": lengths, "payload": payload}],
                schema=pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("width", pa.int32()), ("n_ids", pa.int64()), ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("payload", pa.binary())]),
            )

        for part in slices(batches, limit=wordtokens.SLICE_BYTES):
            got = own.encode(part.column("text"))
            ids, sizes = got.ids, np.diff(got.offsets)
            if end_id is not None:
                ids, sizes = np.insert(ids, got.offsets[1:], end_id), sizes + 1
            if held and held + len(ids) > SEGMENT_IDS:
                yield row()
                keys, lengths, parts, held, segment = [], [], [], 0, segment + 1
            keys += part.column("doc_id").to_pylist()
            lengths += sizes.tolist()
            parts.append(ids.astype(own.dtype).tobytes())
            held += len(ids)
        if keys:
            yield row()

    rows = documents(docs, key, text).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encode, _SEGMENTS).write.option("compression", "zstd").parquet(f"{path}/segments")
    _write_index(docs.sparkSession, path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segment rows of a store."""
    return spark.read.schema(_SEGMENTS).parquet(f"{path}/segments")


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    """Keys with their bucket and two independent hashes."""
    return keys.withColumns({"bucket": F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(buckets)), "h1": F.xxhash64(F.lit(1), "key"), "h2": F.xxhash64(F.lit(2), "key")})


def _slot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(h1 ^ mix64(h2 + np.uint64(level))) % np.uint64(size)).astype(np.int64)


def _fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (mix64(h1 + mix64(~h2)) >> np.uint64(32)).astype("<u4")


def build_levels(h1: np.ndarray, h2: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit levels of a minimal perfect hash over distinct hash pairs, and each pair's number.

    On each level a pair that alone takes its slot stays there; the others go on.
    A pair's number is the count of set bits before its own.
    """
    left, levels, number, base = np.arange(len(h1)), [], np.zeros(len(h1), np.int64), 0
    while len(left):
        size = max(8, int(GAMMA * len(left)))
        slot = _slot(h1[left], h2[left], len(levels), size)
        bits = np.bincount(slot, minlength=size) == 1
        stays = bits[slot]
        number[left[stays]] = base + (np.cumsum(bits) - 1)[slot[stays]]
        base += int(bits.sum())
        levels.append(bits)
        left = left[~stays]
    return levels, number


def find(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The number that the hash gives each pair; -1 where no level has a bit for it."""
    left, number, base = np.arange(len(h1)), np.full(len(h1), -1, np.int64), 0
    for k, bits in enumerate(levels):
        slot = _slot(h1[left], h2[left], k, len(bits))
        hit = bits[slot]
        number[left[hit]] = base + (np.cumsum(bits) - 1)[slot[hit]]
        base += int(bits.sum())
        left = left[~hit]
    return number


_FIELDS = (("shard", "<i4"), ("segment", "<i4"), ("place", "<i4"), ("start", "<i8"), ("n_ids", "<i4"), ("copies", "<i4"))


def _write_index(spark: SparkSession, path: str) -> None:
    rows = spark.read.schema("shard int, segment int, keys array<long>, lengths array<int>").parquet(f"{path}/segments")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = np.array(r["lengths"], np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"key": pa.array(r["keys"], pa.int64()), "shard": np.full(len(n), r["shard"], np.int32), "segment": np.full(len(n), r["segment"], np.int32), "place": np.arange(len(n), dtype=np.int32), "start": np.cumsum(n) - n, "n_ids": n.astype(np.int32)}
                )

    places = rows.mapInArrow(place, "key long, shard int, segment int, place int, start long, n_ids int")
    at = F.struct("shard", "segment", "place", "start", "n_ids")
    keys = places.where("key IS NOT NULL").groupBy("key").agg(F.min(at).alias("at"), F.count("*").cast("int").alias("copies")).select("key", "at.*", "copies")
    total = rows.agg(F.sum(F.size("keys"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_KEYS))

    def build(group: pa.Table) -> pa.Table:
        cols = {c: group.column(c).to_numpy() for c in group.column_names}
        h1, h2 = cols["h1"].astype(np.uint64), cols["h2"].astype(np.uint64)
        levels, number = build_levels(h1, h2)
        order = np.argsort(number)
        row = {"bucket": int(cols["bucket"][0]), "n_keys": len(h1), "levels": [np.packbits(b).tobytes() for b in levels], "sizes": [len(b) for b in levels], "fingerprint": _fingerprint(h1, h2)[order].tobytes()}
        row |= {c: cols[c][order].astype(kind).tobytes() for c, kind in _FIELDS}
        kinds = {"bucket": pa.int64(), "n_keys": pa.int32(), "levels": pa.list_(pa.binary()), "sizes": pa.list_(pa.int32())}
        return pa.Table.from_pylist([row], schema=pa.schema([(c, kinds.get(c, pa.binary())) for c in row]))

    index = _hashed(keys, buckets).drop("key").groupBy("bucket").applyInArrow(build, _INDEX)
    index.withColumn("buckets", F.lit(buckets).cast("long")).write.option("compression", "zstd").parquet(f"{path}/index")


def lookup(keys: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Where the documents of some keys lie: one row per distinct key that the store has.

    A key the store does not have is dropped, but for one in 2**32 whose fingerprint agrees.
    Columns: key, shard, segment, place, start (in the segment), n_ids, copies.
    """
    spark = keys.sparkSession
    index = spark.read.schema(_INDEX + ", buckets long").parquet(f"{path}/index")
    head = index.select("buckets").first()
    wanted = _hashed(keys.select(F.col(key).cast("long").alias("key")).where("key IS NOT NULL").distinct(), head[0] if head else 1)

    def probe(ask: pa.Table, own: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in _PLACES.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        if not own.num_rows or not ask.num_rows:
            return pa.table({c: pa.array([], k) for c, k in zip(names, kinds)})
        row = own.to_pylist()[0]
        levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(row["levels"], row["sizes"])]
        h1, h2 = (ask.column(c).to_numpy().astype(np.uint64) for c in ("h1", "h2"))
        number = find(levels, h1, h2)
        fits = number >= 0
        fits[fits] = np.frombuffer(row["fingerprint"], "<u4")[number[fits]] == _fingerprint(h1, h2)[fits]
        out = {"key": ask.column("key").to_numpy()[fits]} | {c: np.frombuffer(row[c], kind)[number[fits]] for c, kind in _FIELDS}
        return pa.table({c: pa.array(out[c], k) for c, k in zip(names, kinds)})

    return wanted.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(probe, _PLACES)


def fetch(places: DataFrame, path: str) -> DataFrame:
    """The ids of places that ``lookup`` gave: its columns and ``ids``.

    Asked-for places are gathered by segment, so each payload moves at most once.
    """
    wanted = places.groupBy("shard", "segment").agg(F.collect_list(F.struct("key", "place", "start", "n_ids", "copies")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["payload"], f"<u{r['width']}").astype(np.int32)
                rows = [w | {"shard": r["shard"], "segment": r["segment"], "ids": ids[w["start"] : w["start"] + w["n_ids"]]} for w in r["wanted"]]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.int64()), ("shard", pa.int32()), ("segment", pa.int32()), ("place", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int32()), ("copies", pa.int32()), ("ids", pa.list_(pa.int32()))]))

    joined = wanted.join(segments(places.sparkSession, path).select("shard", "segment", "width", "payload"), ["shard", "segment"])
    return joined.mapInArrow(cut, _PLACES + ", ids array<int>")


def contents(spark: SparkSession, path: str) -> DataFrame:
    """What the files of a store hold, by document.

    Columns: key, shard, segment, place, start (ids of all documents before it in the
    store), n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit integers).
    """
    sizes = spark.read.schema("shard int, segment int, n_ids long").parquet(f"{path}/segments")
    by_shard = sizes.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    # one row per shard, that is per task that wrote
    shard_start = by_shard.withColumn("shard_start", F.sum("shard_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    starts = sizes.join(F.broadcast(shard_start) if by_shard.count() < 100_000 else shard_start, "shard").withColumn(
        "before", F.coalesce("shard_start", F.lit(0)) + F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, n = np.frombuffer(r["payload"], f"<u{r['width']}").astype("<u4"), np.array(r["lengths"], np.int64)
                view, ends = memoryview(ids).cast("B"), np.cumsum(n)
                crc = [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_pydict(
                    {"key": pa.array(r["keys"], pa.int64()), "shard": np.full(len(n), r["shard"], np.int32), "segment": np.full(len(n), r["segment"], np.int32), "place": np.arange(len(n), dtype=np.int32), "within": ends - n, "n_ids": n.astype(np.int32), "ids_crc32": np.array(crc, np.int64)}
                )

    rows = segments(spark, path).mapInArrow(digest, "key long, shard int, segment int, place int, within long, n_ids int, ids_crc32 long")
    return rows.join(starts.select("shard", "segment", "before"), ["shard", "segment"]).select("key", "shard", "segment", "place", (F.col("before") + F.col("within")).alias("start"), "n_ids", "ids_crc32")
