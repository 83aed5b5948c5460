"""Benchmark contamination by a prefix-filtered set join.

The words of an item in windows of fixed length are sets of word shingles. All
shingles of a window must occur in a text that holds the window, so one of them
- the rarest over all documents - is the prefix that a match needs. Documents
join windows on that shingle; its offset in the window fixes where the window
would lie, the text's ends bound it, and the words there are compared.

Windows are dealt into blocks of bounded size, and documents meet one block
after another, so what is broadcast is bounded for any benchmark.

A null text has no words; an item without words has no window; an item shorter
than a window is one window. Repeated items count once per id. Rows that repeat
an id are judged each by itself. Extra columns are dropped; empty tables give an
empty result (no documents) or clean documents (no items).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import documents, lowered_words, slices
from tickloom.llm.rolling import BASES, between, rolling, word_hashes

#: Words of a shingle (a shorter window is one shingle).
SHINGLE = 5
#: Windows, with an item each, that a block holds on average.
BLOCK = 200_000


def item_windows(items: DataFrame, window: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows with the ids of their items: words (joined by spaces), items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw, found = lowered_words(part.column("text"))
            words = found.values.to_pylist()
            for k, item in enumerate(part.column("doc_id").to_pylist()):
                own = words[found.offsets[k] : found.offsets[k + 1]]
                seen = list(dict.fromkeys(" ".join(own[i : i + window]) for i in range(max(1, len(own) - window + 1)))) if own else []
                for at in range(0, len(seen), 10_000):
                    yield pa.RecordBatch.from_pydict({"words": pa.array(seen[at : at + 10_000], pa.string()), "item": pa.array([item] * len(seen[at : at + 10_000]), pa.string())})

    ids = documents(items, key, text).select(F.col("doc_id").cast("string").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    return ids.mapInArrow(cut, "words string, item string").groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Members:
    """A sorted set of hashes with a bitmap in front of it."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.sorted = np.unique(hashes)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.sorted & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def where(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of members among hashes, and their numbers in the set."""
        at = np.flatnonzero(self.bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.sorted, hashes[at]), max(len(self.sorted) - 1, 0))
        fits = self.sorted[k] == hashes[at] if len(self.sorted) else np.zeros(0, bool)
        return at[fits], k[fits]


class TextWords:
    """The words of a slice of texts, with hashes of sequences of them."""

    def __init__(self, texts: pa.Array) -> None:
        self.raw, found = lowered_words(texts)
        self.starts, self.ends, self.offsets = found.starts, found.ends, found.offsets
        self.hashes = [rolling(word_hashes(self.raw, self.starts, self.ends, b), b) for b in BASES]
        self.last = np.repeat(self.offsets[1:], np.diff(self.offsets))  # where each word's document ends

    def sequences(self, start: np.ndarray, length: np.ndarray | int, which: int = 0) -> np.ndarray:
        return between(self.hashes[which], start, start + length, BASES[which])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where shingles of k words start, and their hashes."""
        at = np.arange(max(0, len(self.starts) - k + 1))
        at = at[at + k <= self.last[at]]
        return at, self.sequences(at, k)

    def words(self, start: int, length: int) -> bytes:
        return b" ".join(self.raw[a:b].tobytes() for a, b in zip(self.starts[start : start + length], self.ends[start : start + length]))


class Block:
    """Windows of a block: their sizes, hashes, shingles and items."""

    def __init__(self, rows: list) -> None:
        self.words = [r["words"].encode() for r in rows]
        self.items = [r["items"] for r in rows]
        held = TextWords(pa.array([r["words"] for r in rows], pa.string()))
        self.begin, self.size = held.offsets[:-1], np.diff(held.offsets)
        self.code = [held.sequences(self.begin, self.size, w) for w in range(2)]
        self.shingle = np.minimum(self.size, SHINGLE)
        per = self.size - self.shingle + 1
        self.owner = np.repeat(np.arange(len(rows)), per)
        self.place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        self.hashes = held.sequences(self.begin[self.owner] + self.place, self.shingle[self.owner])

    def prefixes(self, counts: dict[int, int]) -> None:
        """Keep the rarest shingle of each window."""
        often = np.array([counts.get(h, 0) for h in self.hashes.tolist()], np.int64)
        order = np.lexsort((self.place, self.hashes, often, self.owner))
        first = order[np.concatenate([[True], self.owner[order][1:] != self.owner[order][:-1]])] if len(order) else order
        self.rare = {}
        for k in np.unique(self.shingle):
            own = first[self.shingle[self.owner[first]] == k]
            members = Members(self.hashes[own])
            own = own[np.argsort(self.hashes[own], kind="stable")]
            bound = np.searchsorted(self.hashes[own], members.sorted), np.searchsorted(self.hashes[own], members.sorted, side="right")
            self.rare[int(k)] = (members, own, *bound)


def _count(docs: DataFrame, block: Block) -> dict[int, int]:
    """Occurrences over all documents of each shingle of a block."""
    sets = {int(k): Members(block.hashes[block.shingle[block.owner] == k]) for k in np.unique(block.shingle)}
    held = docs.sparkSession.sparkContext.broadcast(sets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(m.sorted), np.int64) for k, m in held.value.items()}
        for part in slices(batches):
            text = TextWords(part.column("text"))
            for k, members in held.value.items():
                total[k] += np.bincount(members.where(text.shingles(k)[1])[1], minlength=len(members.sorted))
        for k, n in total.items():
            yield pa.RecordBatch.from_pydict({"h": held.value[k].sorted[n > 0].view(np.int64), "n": n[n > 0]})

    found = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()
    return {r["h"] % (1 << 64): r["n"] for r in found}


def _scan(docs: DataFrame, block: Block | None) -> DataFrame:
    """Matches of one block: doc_id, t, n_words, places, lengths, items."""
    held = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for part in slices(batches):
            text, n = TextWords(part.column("text")), part.num_rows
            starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k, (members, rows, low, high) in own.rare.items() if own else ():
                at, hashes = text.shingles(k)
                hit, which = members.where(hashes)
                times = high[which] - low[which]
                row = rows[np.repeat(low[which], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
                at, window = np.repeat(at[hit], times), own.owner[row]
                start, size = at - own.place[row], own.size[window]
                first = text.offsets[np.searchsorted(text.offsets, at, side="right") - 1]
                fits = (start >= first) & (start + size <= text.last[at])
                start, window, size = start[fits], window[fits], size[fits]
                same = (text.sequences(start, size) == own.code[0][window]) & (text.sequences(start, size, 1) == own.code[1][window])
                starts.append(start[same])
                windows.append(window[same])
            start, window = np.concatenate(starts), np.concatenate(windows)
            exact = np.array([text.words(s, int(own.size[w])) == own.words[w] for s, w in zip(start.tolist(), window.tolist())], bool)
            start, window = start[exact], window[exact]
            order = np.argsort(start, kind="stable")
            start, window = start[order], window[order]
            doc = np.searchsorted(text.offsets, start, side="right") - 1
            bound = np.searchsorted(doc, np.arange(n + 1))
            items = [sorted({i for w in set(window[a:b].tolist()) for i in own.items[w]}) for a, b in zip(bound, bound[1:])]
            lists = [pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(v, pa.int32())) for v in (start - text.offsets[doc], own.size[window] if own else window)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), pa.array(np.diff(text.offsets).astype(np.int64)), *lists, pa.array(items, pa.list_(pa.string()))], names=["doc_id", "t", "n_words", "places", "lengths", "items"])

    return docs.mapInArrow(run, "doc_id long, t long, n_words long, places array<int>, lengths array<int>, items array<string>")


def _covered(found: DataFrame) -> DataFrame:
    """n_hit, items_sha256 and the verdict from matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_words").to_numpy()
            hit = np.zeros(batch.num_rows, np.int64)
            for k, (places, lengths) in enumerate(zip(batch.column("places"), batch.column("lengths"))):
                if len(places):
                    p, s = np.array(places.as_py(), np.int64), np.array(lengths.as_py(), np.int64)
                    change = np.zeros(int(n[k]) + 1, np.int64)
                    np.add.at(change, p, 1)
                    np.add.at(change, p + s, -1)
                    hit[k] = np.count_nonzero(np.cumsum(change))
            items = batch.column("items").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(hit), batch.column("items"), pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items])],
                names=["doc_id", "n_words", "n_hit", "items", "items_sha256"],
            )

    return found.mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<string>, items_sha256 string")


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, one_in: int = 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Which documents hold windows of benchmark items.

    Columns: doc_id, n_words, n_hit (words inside matches), items (sorted ids),
    items_sha256, contaminated (some word is hit, and at least one in ``one_in`` of them).
    """
    own = documents(docs, key, text).withColumn("t", F.xxhash64("text"))
    windows = item_windows(items, window, item_key, item_text).cache()
    pairs = windows.agg(F.sum(F.size("items"))).first()[0] or 0
    blocks = max(1, -(-pairs // BLOCK))
    scans = []
    for k in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).collect()
        block = Block(rows) if rows else None
        if block:
            block.prefixes(_count(own, block))
        scans.append(_scan(own, block))
    windows.unpersist()
    found = scans[0]
    if blocks > 1:
        for other in scans[1:]:
            found = found.unionByName(other)
        # rows that repeat have equal matches, one for each repeat and block
        flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
        merged = found.groupBy("doc_id", "t").agg(F.max("n_words").alias("n_words"), flat("places"), flat("lengths"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count("*").alias("rows"))
        found = merged.withColumn("again", F.explode(F.sequence(F.lit(1), (F.col("rows") / blocks).cast("int")))).drop("again", "rows")
    return _covered(found).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))
