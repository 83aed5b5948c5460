"""Removal of word sequences that an earlier document already has.

A window is a fixed number of consecutive words of one document. A word goes if a
window over it also starts in a document with a smaller id.

Anchors are short word sequences that start at cover positions: those whose
number modulo a period lies in a difference cover. For any two positions some
shift below the period moves both onto cover positions, so two equal windows
share an anchor that lies inside them. Only windows around an anchor that
several documents have are compared. Rolling hashes only propose windows: what they wrongly take for
equal is found to differ, since windows and whole texts are compared by cryptographic digests of their
words (BLAKE2b of 128 bits, SHA-256).

A null text has no words. Rows with a null id lose nothing and make nothing go.
Rows that repeat an id are judged each by itself, and never against each other.
Extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import as_bytes, documents, joined, slices, spaced, written
from tickloom.llm.rolling import BASES, between, rolling, word_hashes

#: Difference covers by period: every difference occurs between two members (fixed values).
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18)}
def period(window: int) -> int:
    """The longest period whose anchors still have about two fifths of a window's words."""
    return max(p for p in COVERS if p == 1 or 5 * (window - p + 1) >= 2 * window)


class Words:
    """The words of a slice of texts with a rolling hash over them."""

    def __init__(self, texts: pa.Array) -> None:
        raw, _ = joined(texts)
        chunks = spaced(texts)
        self.offsets = chunks.offsets
        self.prefix = rolling(word_hashes(raw, chunks.starts, chunks.ends, BASES[0]), BASES[0])

    def hashes(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return between(self.prefix, start, start + length, BASES[0]).view(np.int64)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and word positions (in the slice) where anchors start."""
        step, offsets = period(window), self.offsets
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        at = np.arange(len(doc)) - offsets[doc]
        fits = (at + window - step + 1 <= np.diff(offsets)[doc]) & np.isin(at % step, COVERS[step]) & (np.diff(offsets)[doc] >= window)
        place = np.flatnonzero(fits)
        return doc[place], place


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _lists(doc: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """Values of n documents as lists; ``doc`` ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), pa.array(values))


def summary(docs: DataFrame, window: int) -> DataFrame:
    """Per row: doc_id, t (a hash of its text), n_words, kept_sha256 of all words, distinct anchor hashes."""
    length = window - period(window) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column("text")
            words, n = Words(texts), part.num_rows
            size = np.diff(words.offsets)
            doc, place = words.anchors(window)
            found = words.hashes(place, length)
            order = np.lexsort((found, doc))
            doc, found = doc[order], found[order]
            first = np.ones(len(doc), bool)
            first[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("t"), pa.array(size.astype(np.int64)), pa.array([digest(t.split()) for t in as_bytes(texts)]), _lists(doc[first], found[first], n)],
                names=["doc_id", "t", "n_words", "kept_sha256", "anchors"],
            )

    return docs.mapInArrow(run, "doc_id long, t long, n_words long, kept_sha256 string, anchors array<long>")


def window_digests(text: bytes, places: np.ndarray, window: int) -> list[bytes]:
    """Digests of the words, joined by one space, of the windows that start at the given words."""
    words = text.split()
    line = b" ".join(words)
    at = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).tolist()
    return [hashlib.blake2b(line[at[p] : at[p + window] - 1], digest_size=16).digest() for p in places.tolist()]


def _windows(candidates: DataFrame, window: int) -> DataFrame:
    """Whole windows around shared anchors: w (their digest), doc_id, t, place."""
    step = period(window)
    length = window - step + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"))
            doc, place = words.anchors(window)
            found = words.hashes(place, length)
            shared = part.column("shared")
            wanted, offsets = shared.values.to_numpy(), shared.offsets.to_numpy()
            hit = np.zeros(len(place), bool)
            bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
            for k in range(part.num_rows):
                own = slice(bounds[k], bounds[k + 1])
                hit[own] = np.isin(found[own], wanted[offsets[k] : offsets[k + 1]])
            doc, place = doc[hit], place[hit]
            begin, last = words.offsets[doc], words.offsets[doc + 1] - window
            change = np.zeros(int(words.offsets[-1]) + 2, np.int64)
            low, high = np.maximum(begin, place - step + 1), np.minimum(last, place)
            np.add.at(change, low[low <= high], 1)
            np.add.at(change, high[low <= high] + 1, -1)
            start = np.flatnonzero(np.cumsum(change) > 0)
            own = np.searchsorted(words.offsets, start, side="right") - 1
            texts, ids, t = as_bytes(part.column("text")), part.column("doc_id").to_numpy(), part.column("t").to_numpy()
            cuts = np.searchsorted(own, np.arange(part.num_rows + 1))
            for d in np.unique(own).tolist():
                places = start[cuts[d] : cuts[d + 1]] - words.offsets[d]
                for k in range(0, len(places), 100_000):
                    few = places[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(window_digests(texts[d], few, window), pa.binary()), pa.array(np.full(len(few), ids[d])), pa.array(np.full(len(few), t[d])), pa.array(few.astype(np.int32))], names=["w", "doc_id", "t", "place"])

    return candidates.mapInArrow(run, "w binary, doc_id long, t long, place int")


def covered(places: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n words lie in windows that start at the given places."""
    change = np.zeros(n + window + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, places + window, -1)
    return np.cumsum(change)[:n] > 0


def _strip(matched: DataFrame, window: int) -> DataFrame:
    """Texts with the places of windows that go: doc_id, t, n_removed, kept_sha256, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            removed, texts = [], []
            for text, places in zip(as_bytes(part.column("text")), part.column("places")):
                words = text.split()
                gone = covered(np.array(places.as_py(), np.int64), window, len(words))
                removed.append(int(gone.sum()))
                texts.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g))
            sha = [hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), pa.array(removed, pa.int64()), pa.array(sha), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "t", "n_removed", "kept_sha256", "kept"])

    return matched.mapInArrow(run, "doc_id long, t long, n_removed long, kept_sha256 string, kept string")


def repeated_passages(docs: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What each document keeps: doc_id, n_words, n_removed, kept_sha256, kept_text.

    ``kept_text`` is null where a document keeps all of its words.
    """
    own = documents(docs, key, text).withColumn("t", F.xxhash64("text"))
    row = ["doc_id", "t"]
    seen = written(summary(own, window), "summary")
    named = seen.where("doc_id IS NOT NULL")
    # written, so that the join can split a text that many documents share
    firsts = written(named.groupBy("kept_sha256").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "firsts")
    copies = named.join(firsts, "kept_sha256").where(F.col("doc_id") > F.col("first")).select(*row, "n_words").distinct()

    anchors = named.select(F.explode("anchors").alias("anchor"), *row)
    # written, so that a join with few but hot keys can be split
    several = written(anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"), "several")
    shared = anchors.join(several, "anchor").groupBy(*row).agg(F.collect_set("anchor").alias("shared"))
    # copies lose every word and have no window that their first document lacks
    shared = shared.join(copies, row, "left_anti")
    candidates = written(own.join(shared, row), "candidates")
    windows = _windows(candidates, window)
    earliest = written(windows.groupBy("w").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("w", "low"), "earliest")
    later = windows.join(earliest, "w").where(F.col("doc_id") > F.col("low"))
    places = later.groupBy(*row).agg(F.collect_set("place").alias("places"))
    stripped = _strip(candidates.select(*row, "text").join(places, row), window)

    changed = stripped.dropDuplicates(row).select(*row, F.col("n_removed").alias("gone"), F.col("kept_sha256").alias("sha"), "kept")
    empty = copies.where(F.col("n_words") >= window).select(*row, F.col("n_words").alias("gone"), F.lit(digest([])).alias("sha"), F.lit("").alias("kept"))
    result = seen.drop("anchors").join(changed.union(empty), row, "left")
    return result.select("doc_id", "n_words", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha", "kept_sha256").alias("kept_sha256"), F.col("kept").alias("kept_text"))
