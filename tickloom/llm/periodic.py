"""Runs of repeated words: stretches with a small period, found by divide and conquer.

Words of a slice of texts become numbers. A document is halved again and again; a run
crosses the midpoint of exactly one piece that holds all of it. For a period q the run
through a midpoint is what the sequence shifted by q agrees with on both sides of it,
which two Z-functions answer for all periods at once (Main and Lorentz). All pieces of a
level are sifted together: a run of ``power`` periods has half of them on one side of the
midpoint, so three words there agree with the word q on; only pieces where some
period passes need their Z-functions. A run that a neighbouring word extends belongs to a
larger piece and is dropped; of equal intervals the smallest period stays.

A null or empty text has no words and no runs. Each row is judged by itself, whatever its
id, so null and repeated ids are kept as they are. Extra columns are dropped; an empty table
gives an empty result. Memory grows with the longest text of a task, not with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import documents, slices, spaced


def z_values(s: list[int]) -> list[int]:
    """For each position the length of the longest common prefix with the whole sequence."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    if n:
        z[0] = n
    return z


def _through(piece: list[int], mid: int, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stretches begin and end that hold words ``mid`` - 1 and ``mid`` - 1 + q and have period q."""
    on = np.array(z_values(piece[mid:]))
    back = piece[::-1]
    before = np.array(z_values(back[len(piece) - mid :] + [-1] + back))[mid + 1 :]
    begin = mid - before[len(piece) - mid - periods]
    end = mid + periods + np.where(periods < len(on), on[np.minimum(periods, len(on) - 1)], 0)
    return begin, end


def _sifted(ids: np.ndarray, low: np.ndarray, high: np.ndarray, mid: np.ndarray, power: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Pieces and periods that may hold a run with half its periods after the midpoint, then before it."""
    for mirrored in (False, True):
        room = (mid - low) if mirrored else (high - mid)
        # half of ``power`` periods, rounded up, must fit on the side looked at, all of them into the piece
        most = np.minimum(2 * room // power, (high - low) // power)
        piece = np.repeat(np.arange(len(low)), most)
        q = np.arange(len(piece)) - np.repeat(np.cumsum(most) - most, most) + 1
        m = mid[piece]
        if mirrored:
            near, far = m - q, m - (power * q + 1) // 2
        else:
            near, far = m - 1, m + (power * q + 1) // 2 - q - 1
        fits = np.flatnonzero(ids[near] == ids[near + q])
        piece, q, near, far = piece[fits], q[fits], near[fits], far[fits]
        middle = (near + far) // 2
        good = (ids[far] == ids[far + q]) & (ids[middle] == ids[middle + q])
        yield mirrored, piece[good], q[good]


def runs(ids: np.ndarray, offsets: np.ndarray, power: int = 4, least: int = 6) -> np.ndarray:
    """Rows (document, start, length, period) of the runs of documents given as word numbers.

    A run is a stretch with smallest period q and a length of at least ``least`` and
    ``power`` * q (``power`` of 2 or more) that no neighbouring word extends with period q.
    """
    found: list[np.ndarray] = []
    doc = np.arange(len(offsets) - 1)
    low, high = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    while True:
        large = high - low >= max(least, power)
        doc, low, high = doc[large], low[large], high[large]
        if not len(doc):
            break
        mid = (low + high) // 2
        for mirrored, piece, q in _sifted(ids, low, high, mid, power):
            cuts = np.flatnonzero(np.diff(piece)) + 1
            for own, periods in zip(np.split(piece, cuts), np.split(q, cuts)):
                if not len(own):
                    continue
                k = own[0]
                a, b, m = int(low[k]), int(high[k]), int(mid[k])
                words = ids[a:b].tolist()
                if mirrored:
                    begin, end = _through(words[::-1], b - m, periods)
                    begin, end = b - end, b - begin
                else:
                    begin, end = _through(words, m - a, periods)
                    begin, end = a + begin, a + end
                first, last = offsets[doc[k]], offsets[doc[k] + 1]
                open_left = (begin > first) & (ids[np.maximum(begin - 1, 0)] == ids[np.maximum(begin - 1, 0) + periods])
                open_right = (end < last) & (ids[np.minimum(end, last - 1)] == ids[np.minimum(end, last - 1) - periods])
                whole = (end - begin >= np.maximum(least, power * periods)) & ~open_left & ~open_right
                found.append(np.stack([np.full(whole.sum(), doc[k]), begin[whole] - first, (end - begin)[whole], periods[whole]], 1))
        doc, low, high = np.concatenate([doc, doc]), np.concatenate([low, mid]), np.concatenate([mid, high])
    rows = np.concatenate([np.zeros((0, 4), np.int64), *found])
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    again = np.zeros(len(rows), bool)
    again[1:] = (rows[1:, :3] == rows[:-1, :3]).all(1)
    rows = rows[~again]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def collapse(docs: DataFrame, power: int = 4, least: int = 6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What each row repeats: doc_id, n_words, runs (start, length, period; by start, then period) and
    ``collapsed``, its words without those that a run holds after its first period, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            chunks = spaced(part.column("text"))
            coded = chunks.values.dictionary_encode()
            ids, offsets = coded.indices.to_numpy().astype(np.int64), chunks.offsets.astype(np.int64)
            rows = runs(ids, offsets, power, least)
            change = np.zeros(len(ids) + 1, np.int64)
            start = offsets[rows[:, 0]] + rows[:, 1]
            np.add.at(change, start + rows[:, 3], 1)
            np.add.at(change, start + rows[:, 2], -1)
            kept = np.cumsum(change)[:-1] == 0
            counts = np.concatenate([[0], np.cumsum(kept)])[offsets]
            words = chunks.values.filter(pa.array(kept)).to_pylist()
            listed = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[:, 0], np.arange(part.num_rows + 1)), pa.int32()), listed), pa.array([" ".join(words[a:b]) for a, b in zip(counts, counts[1:])], pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return documents(docs, key, text).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
