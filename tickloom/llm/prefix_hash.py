"""Prefix polynomial hashes of texts: equality of spans, longest common extensions, fingerprints.

The hash of the first i bytes is a polynomial modulo the prime 2**31 - 1 at a fixed random
point; two points give 62 bits. The hash of any span follows from two prefixes, so equal
spans are told in constant time, and how far two texts agree from two places on is
found by binary search over prefixes.

A fingerprint is the hash of the whole text and a sketch of all its spans of ``WIDTH``
bytes: 128 buckets, each with the least of the mixed span hashes that fall into it.
The likeness of two fingerprints is the share of spans that both texts have, between 0
and 1 (the Dice coefficient, from the share of buckets that agree); equal texts have equal
fingerprints and likeness 1, and an empty text is unlike any other one.

``compared`` sets each text beside the one that follows in descending order of id: rows are
dealt to tasks by ranges of ids, and the first row of each range is lent to the range before it,
the first of all to the last, so every text meets its follower inside one task and texts
shuffle once. Rows of one id follow each other by text; those without an id come last. All rows
of one id, or without one, are in one task, which reads them one after the other.

A null text counts as empty. Extra columns are dropped; an empty table gives an empty
result; a single row follows itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import as_bytes, documents, joined, mix64, slices

PRIME = (1 << 31) - 1
#: Points of the two polynomials (random numbers, fixed values).
POINTS = (1_283_907_413, 903_554_771)
#: Bytes of a span of the sketch, buckets, bytes hashed at a time.
WIDTH, BUCKETS, BLOCK = 16, 128, 1 << 20

_tables: dict[int, np.ndarray] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """Numbers under 2**62 modulo the prime."""
    p = np.uint64(PRIME)
    x = (x & p) + (x >> np.uint64(31))
    x = (x & p) + (x >> np.uint64(31))
    return np.where(x == p, np.uint64(0), x)


def _powers(point: int, n: int) -> np.ndarray:
    """The first n powers of a point, or more."""
    held = _tables.get(point, np.ones(1, np.uint64))
    while len(held) < n:
        held = np.concatenate([held, _fold(held * np.uint64(pow(point, len(held), PRIME)))])
    _tables[point] = held
    return held


class Prefixes:
    """Hashes of all prefixes of a byte array at one point."""

    def __init__(self, raw: np.ndarray, point: int = POINTS[0]) -> None:
        n = len(raw)
        self.inverse = pow(point, -1, PRIME)
        terms = _fold((raw.astype(np.uint64) + np.uint64(1)) * _powers(point, n)[:n])
        # a sum of terms under 2**31 can't overflow before 2**33 bytes
        self.sums = _fold(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)]))
        self.down = _powers(self.inverse, n + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from ``start`` to ``end``; they do not depend on where the span lies."""
        return _fold(_fold(self.sums[end] + np.uint64(PRIME) - self.sums[start]) * self.down[start])


def extension(one: list[Prefixes], a: np.ndarray, other: list[Prefixes], b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes, up to ``most``, agree from places a and b on, by binary search over prefixes."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = np.ones(len(a), bool)
        for x, y in zip(one, other):
            same &= x.spans(a, a + middle) == y.spans(b, b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def common_prefix(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Bytes that texts (joined bytes and bounds) agree in from their starts on; long texts block by block."""
    (x, a), (y, b) = one, other
    most = np.minimum(np.diff(a), np.diff(b))
    if max(len(x), len(y)) <= 4 * BLOCK:
        hashes = [[Prefixes(r, p) for p in POINTS] for r in (x, y)]
        return extension(hashes[0], a[:-1], hashes[1], b[:-1], most)
    out = np.zeros(len(most), np.int64)
    for k, size in enumerate(most.tolist()):
        while out[k] < size:
            step = min(BLOCK, size - int(out[k]))
            parts = [[Prefixes(r[s + out[k] : s + out[k] + step], p) for p in POINTS] for r, s in ((x, a[k]), (y, b[k]))]
            more = int(extension(parts[0], np.zeros(1, np.int64), parts[1], np.zeros(1, np.int64), np.array([step]))[0])
            out[k] += more
            if more < step:
                break
    return out


def sketches(raw: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of whole texts (texts x points) and their sketches (texts x buckets, 0: empty)."""
    n = len(begin) - 1
    size = np.diff(begin)
    least = np.full(n * BUCKETS, 1 << 32, np.uint64)
    total = np.zeros((n, len(POINTS)), np.uint64)
    width = np.minimum(size, WIDTH)
    for at in range(0, len(raw), BLOCK):
        piece = raw[at : at + BLOCK + WIDTH - 1]
        texts = np.flatnonzero((begin[:-1] < at + BLOCK) & (begin[1:] > at))
        a, b = np.maximum(begin[texts], at), np.minimum(begin[texts + 1], at + BLOCK)
        hashes = [Prefixes(piece, p) for p in POINTS]
        for k, (h, point) in enumerate(zip(hashes, POINTS)):
            shift = np.array([pow(point, int(x), PRIME) if x else 1 for x in a - begin[texts]], np.uint64)
            total[texts, k] = _fold(total[texts, k] + _fold(h.spans(a - at, b - at) * shift))
        count = np.maximum(0, np.minimum(b, begin[texts + 1] - width[texts] + 1) - a)
        own = np.repeat(texts, count)
        start = np.repeat(a - at, count) + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        mixed = mix64(hashes[0].spans(start, start + width[own]))
        np.minimum.at(least, own * BUCKETS + (mixed >> np.uint64(57)).astype(np.int64), (mixed >> np.uint64(16)) & np.uint64(0xFFFFFFFF))
    kept = np.where(least >> np.uint64(32) > 0, np.uint64(0), least % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    return total, kept.reshape(n, BUCKETS)


def written_out(total: np.ndarray, kept: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal digits: 8 for each point, 4 for each bucket."""
    whole = total.astype(">u4").view(np.uint8).reshape(len(total), -1)
    data = np.concatenate([whole, kept.astype(">u2").view(np.uint8).reshape(len(kept), 2 * BUCKETS)], 1)
    return [row.tobytes().hex() for row in data]


def likeness(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The likeness, row by row, of fingerprints as ``sketches`` gives them."""
    (t, x), (u, y) = one, other
    agree = ((x == y) & (x > 0)).sum(1)
    share = agree / np.maximum(1, ((x > 0) | (y > 0)).sum(1))
    return np.where((t == u).all(1) & (x == y).all(1), 1.0, 2 * share / (1 + share))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars (code points), fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw, begin = joined(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _chars(raw, begin), pa.array(written_out(*sketches(raw, begin)), pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return documents(docs, key, text).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _chars(raw: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.array(np.diff(np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[begin]).astype(np.int64))


def succession(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) dealt by ranges of descending ids, with ``part``, the range, and ``lent``, whether a row
    only follows the last one of its range; sorted inside tasks, so that each row's follower comes next."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    found = ids.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 10_000).alias("x")).first()["x"] or []
    edges = [-float("inf"), *sorted({float(x) for x in found or [0]}), float("inf")]
    bucket = Bucketizer(splits=edges, inputCol="_id", outputCol="_bucket", handleInvalid="keep")
    # ascending buckets of the negated order; rows without an id are the last range
    dealt = lambda df: bucket.transform(df.withColumn("_id", F.col("doc_id").cast("double"))).withColumn("part", F.when(F.col("doc_id").isNull(), len(edges) - 1).otherwise(len(edges) - 2 - F.col("_bucket")).cast("int")).drop("_id", "_bucket")
    # one row for each range at most
    heads = sorted((r["part"], r["head"]) for r in dealt(ids).groupBy("part").agg(F.max("doc_id").alias("head")).collect())
    lending = [(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)]
    lent = spark.createDataFrame(lending, "head long, to int")
    both = dealt(docs).join(F.broadcast(lent), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own, other = F.struct(F.col("part"), F.lit(False).alias("lent")), F.struct(F.col("to").alias("part"), F.lit(True).alias("lent"))
    spread = both.select("doc_id", "text", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, other))).alias("at"))
    n = len(edges)
    return spread.select("doc_id", "text", "at.*").repartitionById(n, F.col("part")).sortWithinPartitions("part", "lent", F.desc_nulls_last("doc_id"), "text")


def compared(docs: DataFrame, edit: Callable[[str, str], str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text beside an edited form of it and beside its follower (see above).

    ``edit`` makes the edited text from a text and the one that follows. Per row: doc_id, n_chars, edited,
    fingerprint, edited_fingerprint, near_edited and near_next (likeness of its fingerprint to that
    of the edited text and of the follower), common_bytes (that the text and the edited one begin with).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for part in slices(batches):
            raw, begin = joined(part.column("text"))
            total, kept = sketches(raw, begin)
            names, lent = part.column("part").to_pylist(), part.column("lent").to_pylist()
            ids, texts = part.column("doc_id").to_pylist(), [t.decode("utf-8", "surrogateescape") for t in as_bytes(part.column("text"))]
            if last is not None:
                names, lent, ids, texts = [last[0], *names], [last[1], *lent], [last[2], *ids], [last[3], *texts]
                total, kept = np.concatenate([last[4], total]), np.concatenate([last[5], kept])
            own = [k for k in range(len(ids) - 1) if not lent[k] and names[k] == names[k + 1]]
            last = (names[-1], lent[-1], ids[-1], texts[-1], total[-1:], kept[-1:])
            for few in _few(own, texts):
                edited = pa.array([edit(texts[k], texts[k + 1]).encode("utf-8", "surrogateescape") for k in few], pa.binary()).cast(pa.string())
                mine = joined(pa.array([texts[k].encode("utf-8", "surrogateescape") for k in few], pa.binary()))
                theirs = joined(edited)
                k = np.array(few)
                now, after, new = (total[k], kept[k]), (total[k + 1], kept[k + 1]), sketches(*theirs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[k] for k in few], pa.int64()), _chars(*mine), edited, pa.array(written_out(*now)), pa.array(written_out(*new)), pa.array(likeness(now, new)), pa.array(likeness(now, after)), pa.array(common_prefix(mine, theirs))],
                    names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_bytes"],
                )

    return succession(documents(docs, key, text)).mapInArrow(run, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_bytes long")


def _few(rows: list[int], texts: list[str]) -> Iterator[list[int]]:
    """Rows in groups of about ``BLOCK`` characters, at least one each."""
    held, size = [], 0
    for k in rows:
        if held and size + len(texts[k]) > BLOCK:
            yield held
            held, size = [], 0
        held.append(k)
        size += len(texts[k])
    if held:
        yield held
