"""Near duplicates by SimHash fingerprints and Golay-code keys.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Of two
fingerprints that differ in at most two bits, one segment agrees exactly and the
next one (cyclically) differs in at most two. The binary Golay code of 23 bits
has, for any two words at most two bits apart, a codeword within four bits of
both (the one nearest to their midpoint), and a word has at most six codewords
that near. So each fingerprint gets a few keys - a segment and the index of a
codeword near the next one - and fingerprints that link share a key. Rows are
then dealt by key, and distances are verified inside a key.

A null text is empty; a text without words has fingerprint zero and links like
any other. Copies share a fingerprint and count once. A row with a null id takes
no part in links; it gets the component of its fingerprint, if there is one.
Extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import as_bytes, documents, mix64, slices, written
from tickloom.llm.graph import components

_ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Generator polynomial of the binary Golay code of length 23 (a fixed value).
GENERATOR = 0b101011100011
#: Lowest bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Differing bits up to which fingerprints link; the keys are made for this bound.
MAX_BITS = 2
#: Rows of a key up to which all of its pairs are compared.
FEW = 8
#: Candidate midpoints that a task holds at a time.
MIDPOINTS = 1 << 20

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANE = (256 * np.arange(8)).astype(np.int64)


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of the word shingles of a text; repeats count."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    found = text.translate(_ASCII_LOWER).split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends]
    hashes = [digest(line[a : b - 1], 42) for a, b in zip(starts, ends[words - 1 :])] or [digest(line, 42)]
    lanes = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    count = np.bincount((lanes + _LANE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * count.ravel() > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id and fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            got = np.array([fingerprint(t, words) for t in as_bytes(part.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return documents(docs, key, text).mapInArrow(run, "doc_id long, fp long")


def _syndrome(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where((v >> bit) & 1, GENERATOR << (bit - 11), 0)
    return v


def _near_table() -> np.ndarray:
    """By syndrome: the error patterns of at most four bits, -1 where there are fewer than six."""
    table, used = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], np.int64)
        for e, s in zip(errors.tolist(), _syndrome(errors).tolist()):
            table[s, used[s]] = e
            used[s] += 1
    return table


_near: list[np.ndarray] = []


def codewords(v: np.ndarray) -> np.ndarray:
    """Indices of all Golay codewords within four bits of each 23-bit word; -1 fills up."""
    if not _near:
        _near.append(_near_table())
    errors = _near[0][_syndrome(v)]
    return np.where(errors >= 0, (v[:, None] ^ errors) >> 11, -1)


def _keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of fingerprints."""
    rows, keys = [], []
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    for k in range(3):
        near = codewords(parts[(k + 1) % 3])
        row, col = np.nonzero(near >= 0)
        rows.append(row)
        keys.append((k << 34) | (parts[k][row] << 12) | near[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least reachable number of each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        then = label.copy()
        np.minimum.at(then, a, low)
        np.minimum.at(then, b, low)
        then = then[then]
        if (then == label).all():
            return label
        label = then


def _linked(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what lies within two bits among many fingerprints.

    Two fingerprints at most two bits apart both lie within one bit of some midpoint,
    so equal midpoints are looked for, a share of all midpoints at a time.
    """
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    shares = -(-len(fps) * len(flips) // MIDPOINTS)
    label = np.arange(len(fps))
    for share in range(shares):
        row, mid = [], []
        for begin in range(0, len(fps), 4096):
            m = fps[begin : begin + 4096, None] ^ flips
            r, c = np.nonzero(mix64(m) % np.uint64(shares) == share)
            row.append(r + begin)
            mid.append(m[r, c])
        row, mid = np.concatenate(row), np.concatenate(mid)
        order = np.argsort(mid)
        row, mid = row[order], mid[order]
        same = mid[1:] == mid[:-1]
        a, b = row[:-1][same], row[1:][same]
        label = np.minimum(label, _labels(len(fps), np.concatenate([a, np.arange(len(fps))]), np.concatenate([b, label])))
    label = _labels(len(fps), np.arange(len(fps)), label)
    other = np.flatnonzero(label != np.arange(len(fps)))
    return other, label[other]


def _links(fps: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that link within runs of rows; ``bound``: where runs start, and the end."""
    size = np.diff(bound)
    run = np.repeat(np.arange(len(size)), size)
    few = (size <= FEW)[run]
    left, right = [], []
    for shift in range(1, FEW):
        i = np.flatnonzero(few[:-shift] & (run[:-shift] == run[shift:])) if len(run) > shift else np.zeros(0, np.int64)
        i = i[np.bitwise_count(fps[i] ^ fps[i + shift]) <= MAX_BITS]
        left.append(i)
        right.append(i + shift)
    for k in np.flatnonzero(size > FEW):
        a, b = _linked(fps[bound[k] : bound[k + 1]])
        left.append(a + bound[k])
        right.append(b + bound[k])
    return np.concatenate(left), np.concatenate(right)


def near_components(fps: DataFrame) -> DataFrame:
    """Component of every document by links of at most two differing bits.

    ``fps``: doc_id and fp, as ``fingerprints`` gives them; it is read more than once.
    Columns: doc_id, fp, component_id (smallest doc_id reachable).
    """
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = (batch.column(c).to_numpy() for c in ("fp", "rep"))
            row, keys = _keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[row]), pa.array(rep[row])], names=["key", "fp", "rep"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def links(cols: list[np.ndarray]) -> pa.RecordBatch:
            bound = np.concatenate([[0], np.flatnonzero(np.diff(cols[0])) + 1, [len(cols[0])]])
            a, b = _links(cols[1].view(np.uint64), bound)
            return pa.RecordBatch.from_arrays([pa.array(cols[2][a]), pa.array(cols[2][b])], names=["a", "b"])

        for batch in batches:
            got = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "fp", "rep"))]
            # the last key may go on in the next batch
            cut = int(np.searchsorted(got[0], got[0][-1])) if len(got[0]) else 0
            held = [g[cut:] for g in got]
            if cut:
                yield links([g[:cut] for g in got])
        if len(held[0]):
            yield links(held)

    dealt = classes.where("rep IS NOT NULL").mapInArrow(deal, "key long, fp long, rep long")
    edges = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long")
    found = components(edges)
    classes = classes.join(found, classes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    # written, so that the join can split a fingerprint that many copies share
    return fps.join(written(classes, "classes"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint and component of every document: doc_id, fp, component_id."""
    return near_components(written(fingerprints(docs, words, key, text), "fingerprints"))
