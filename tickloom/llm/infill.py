"""Fill-in-the-middle form of documents, cut by a parallel scan of a finite automaton.

The automaton reads bytes; it counts units (code points or words) and finds marks
that a text must not hold. Its state at a place depends on all bytes before it, but a
chunk's effect does not: each chunk emits, for every state it may be entered in, the
state it leaves and what it counted. Such functions compose associatively, so a scan over
chunks gives the state and count at each chunk's start, and a cut at unit k is looked for
in the one chunk whose counts reach it.

Texts of up to a block are scanned within the task that reads them, as many short chunks
side by side. Longer ones are cut into blocks that are dealt to all tasks; each block emits
one function, the functions of a document (one small row per block) are composed, and only
blocks that hold a cut are looked at again.

A null text counts as empty. A null id counts as an empty string of digits. Rows that repeat
an id are treated alike, each by itself. Extra columns are dropped; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import as_bytes, documents, joined, slices, written

#: Bytes of a chunk, within a task; bytes of a block, dealt to tasks.
CHUNK, BLOCK = 256, 1 << 20
#: Marks of the parts (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_HIT = 1 << 20


class Automaton(NamedTuple):
    """By state and byte (257 columns, the last one for "no byte"): the next state times 257, and
    what it counts (1 for a unit, _HIT for a mark). State 0 is the start."""

    move: np.ndarray
    gain: np.ndarray
    states: int


def _code_point(state: int, byte: int) -> tuple[int, bool]:
    """State: continuation bytes to come. A unit begins at each byte that does not continue one."""
    if 0x80 <= byte < 0xC0:
        return (state - 1, False) if state else (0, True)
    return (0 if byte < 0xC0 else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3), True


def _word(state: int, byte: int) -> tuple[int, bool]:
    """State: 1 inside a word, which is a run of bytes other than ASCII white space."""
    inside = byte not in (32, 9, 10, 11, 12, 13)
    return int(inside), inside and not state


UNITS = {"code_point": _code_point, "word": _word}


def automaton(unit: str = "code_point", marks: tuple[str, ...] = (PREFIX, SUFFIX, MIDDLE)) -> Automaton:
    """The product of the automaton of a unit and the one that finds any of the marks."""
    step, patterns = UNITS[unit], [m.encode() for m in marks]
    known: dict[tuple[int, bytes], int] = {(0, b""): 0}
    queue, move, gain = [(0, b"")], [], []
    for state, held in queue:
        to, got = [], []
        for byte in range(256):
            after, counted = step(state, byte)
            seen = held + bytes([byte])
            hit = any(seen.endswith(p) for p in patterns)
            left = next(seen[k:] for k in range(len(seen) + 1) if any(p.startswith(seen[k:]) and p != seen[k:] for p in patterns) or k == len(seen))
            if (after, left) not in known:
                known[after, left] = len(known)
                queue.append((after, left))
            to.append(known[after, left] * 257)
            got.append(counted + hit * _HIT)
        move.append([*to, len(move) * 257])
        gain.append([*got, 0])
    return Automaton(np.array(move, np.int32).ravel(), np.array(gain, np.int32).ravel(), len(known))


class Functions(NamedTuple):
    """Effects of stretches of bytes by entry state: state left, units and marks counted (stretches x states)."""

    ends: np.ndarray
    units: np.ndarray
    hits: np.ndarray


def composed(first: Functions, then: Functions) -> Functions:
    """The effect of stretches read one after the other; associative."""
    at = first.ends
    take = lambda x: np.take_along_axis(x, at, 1)
    return Functions(take(then.ends), first.units + take(then.units), first.hits + take(then.hits))


class Scan:
    """A slice of texts under an automaton: functions of its chunks, composed along each text."""

    def __init__(self, texts: pa.Array, rule: Automaton) -> None:
        self.rule = rule
        self.raw, self.begin = joined(texts)
        size = np.diff(self.begin)
        per = -(-size // CHUNK)
        self.doc = np.repeat(np.arange(len(size)), per)
        self.first = np.cumsum(per) - per
        self.number = np.arange(len(self.doc)) - self.first[self.doc]
        self.start = self.begin[self.doc] + self.number * CHUNK
        self.stop = np.minimum(self.start + CHUNK, self.begin[self.doc + 1])
        own = self._functions()
        reach = 1
        while len(self.doc) and reach <= self.number.max():
            late = np.flatnonzero(self.number >= reach)
            joint = composed(Functions(*(x[late - reach] for x in own)), Functions(*(x[late] for x in own)))
            for x, y in zip(own, joint):
                x[late] = y
            reach *= 2
        #: per chunk: effect of its text up to its end
        self.upto = own

    def _bytes(self, chunks: np.ndarray) -> np.ndarray:
        """Bytes of chunks, one column each; 256 beyond their end."""
        at = self.start[chunks] + np.arange(CHUNK)[:, None]
        return np.where(at < self.stop[chunks], self.raw[np.minimum(at, max(0, len(self.raw) - 1))].astype(np.int32), 256)

    def _functions(self) -> Functions:
        n = len(self.doc)
        data = self._bytes(np.arange(n)) if n else np.zeros((CHUNK, 0), np.int32)
        state = np.repeat(np.arange(self.rule.states, dtype=np.int32)[:, None] * 257, n, 1)
        count = np.zeros_like(state)
        for row in data:
            at = state + row
            count += self.rule.gain[at]
            state = self.rule.move[at]
        return Functions((state.T // 257).astype(np.int64), (count.T % _HIT).astype(np.int64), (count.T // _HIT).astype(np.int64))

    def whole(self) -> Functions:
        """The effect of each text; that of an empty one changes nothing."""
        n = len(self.begin) - 1
        none = np.zeros((n, self.rule.states), np.int64)
        out = Functions(none + np.arange(self.rule.states), none.copy(), none.copy())
        full = np.flatnonzero(np.diff(self.begin))
        last = np.searchsorted(self.doc, full, side="right") - 1
        for x, y in zip(out, self.upto):
            x[full] = y[last]
        return out

    def select(self, doc: np.ndarray, unit: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """The byte (in its text) at which a unit of a text begins, given the state the text is entered in;
        its length if it has no such unit."""
        out = (self.begin[doc + 1] - self.begin[doc]).astype(np.int64)
        chunk = np.zeros(len(doc), np.int64)
        for k, (d, u, e) in enumerate(zip(doc, unit, entry)):
            a, b = np.searchsorted(self.doc, [d, d + 1])
            chunk[k] = a + np.searchsorted(self.upto.units[a:b, e], u + 1) if b > a and self.upto.units[b - 1, e] > u else -1
        held = np.flatnonzero(chunk >= 0)
        chunk, entry, unit = chunk[held], entry[held], unit[held]
        inner = self.number[chunk] > 0
        before = np.maximum(chunk - 1, 0)
        state = np.where(inner, self.upto.ends[before, entry], entry).astype(np.int32) * 257 if len(held) else np.zeros(0, np.int32)
        count = np.where(inner, self.upto.units[before, entry], 0) if len(held) else np.zeros(0, np.int64)
        place = np.full(len(held), -1, np.int64)
        for k, row in enumerate(self._bytes(chunk) if len(held) else ()):
            at = state + row
            count = count + self.rule.gain[at] % _HIT
            state = self.rule.move[at]
            place[(place < 0) & (count == unit + 1)] = k
        out[held] = self.number[chunk] * CHUNK + place
        return out


def _draw(seed: str) -> list[Column]:
    """Four numbers under 2**32 from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _within(docs: DataFrame, unit: str) -> DataFrame:
    """Texts with n units, whether they hold a mark, cuts in units (c1, c2) and in bytes (b1, b2); one task each."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = automaton(unit)
        for part in slices(batches):
            scan = Scan(part.column("text"), rule)
            whole = scan.whole()
            n = whole.units[:, 0]
            cuts = [part.column(h).to_numpy() % (n + 1) for h in ("h1", "h2")]
            cuts = [np.minimum(*cuts), np.maximum(*cuts)]
            rows = np.arange(part.num_rows)
            places = [scan.select(rows, c, np.zeros(len(rows), np.int64)) for c in cuts]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(n), pa.array(whole.hits[:, 0] > 0), *map(pa.array, cuts), *map(pa.array, places)], names=[*names, "n", "marked", "c1", "c2", "b1", "b2"])

    kinds = ", ".join(f"{c} {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{kinds}, n long, marked boolean, c1 long, c2 long, b1 long, b2 long")


def _dealt(docs: DataFrame, unit: str, block: int) -> DataFrame:
    """As ``_within``, for texts of several blocks that are scanned by different tasks."""
    held = written(docs.withColumn("row", F.monotonically_increasing_id()), "giants")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), as_bytes(batch.column("text"))):
                for k in range(0, len(text), block):
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([k // block]), pa.array([text[k : k + block]], pa.binary())], names=["row", "block", "part"])

    blocks = written(held.select("row", "text").mapInArrow(cut, "row long, block long, part binary").repartition("row", "block"), "blocks")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = automaton(unit)
        for part in slices(batches, "part"):
            whole = Scan(part.column("part"), rule).whole()
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("block"), *(pa.array(x.tolist(), pa.list_(pa.int64())) for x in whole)], names=["row", "block", *Functions._fields])

    functions = blocks.mapInArrow(scan, "row long, block long, ends array<long>, units array<long>, hits array<long>")

    def entered(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        state, units, hits, entry, before = 0, 0, 0, [], []
        for ends, n, marks in zip(rows["ends"], rows["units"], rows["hits"]):
            entry.append(state)
            before.append(units)
            units, hits, state = units + int(n[state]), hits + int(marks[state]), int(ends[state])
        return pd.DataFrame({"row": rows["row"], "block": rows["block"], "entry": entry, "before": before, "n": units, "marked": hits > 0})

    # a group holds one small row per block of a document
    entries = written(functions.groupBy("row").applyInPandas(entered, "row long, block long, entry long, before long, n long, marked boolean"), "entries")
    own = held.drop("text").join(entries.groupBy("row").agg(F.max("n").alias("n"), F.max("marked").alias("marked")), "row")
    one, two = (F.col(h) % (F.col("n") + 1) for h in ("h1", "h2"))
    own = own.withColumns({"c1": F.least(one, two), "c2": F.greatest(one, two)})
    ends = entries.withColumn("after", F.lead("before", 1).over(_by_block())).withColumn("after", F.coalesce("after", "n"))
    sought = ends.join(own.select("row", F.explode(F.array("c1", "c2")).alias("cut")).distinct(), "row").where((F.col("cut") >= F.col("before")) & (F.col("cut") < F.col("after")))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = automaton(unit)
        for part in slices(batches, "part"):
            found = Scan(part.column("part"), rule).select(np.arange(part.num_rows), part.column("unit").to_numpy(), part.column("entry").to_numpy())
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("cut"), pa.array(part.column("block").to_numpy() * block + found)], names=["row", "cut", "at"])

    looked = blocks.join(sought.select("row", "block", "cut", "entry", (F.col("cut") - F.col("before")).alias("unit")), ["row", "block"])
    places = written(looked.mapInArrow(select, "row long, cut long, at long"), "places")
    out = held.select("row", *docs.columns).join(own.select("row", "n", "marked", "c1", "c2"), "row")
    for cut_, at in (("c1", "b1"), ("c2", "b2")):
        out = out.join(places.select("row", F.col("cut").alias(cut_), F.col("at").alias(at)), ["row", cut_], "left").withColumn(at, F.coalesce(at, F.octet_length("text").cast("long")))
    return out.select(*docs.columns, "n", "marked", "c1", "c2", "b1", "b2")


def _by_block():
    from pyspark.sql import Window

    return Window.partitionBy("row").orderBy("block")


def transform(docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, unit: str = "code_point", key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, n units, form (plain, psm or spm), prefix_units and middle_units (null if plain),
    output and restored, the text rebuilt from output and form.

    Cuts and forms are drawn from a digest of ``seed`` and the id. Texts that are empty or hold a mark
    stay plain, and so do ``plain_percent`` of the others; ``spm_percent`` of the rest put the suffix first.
    """
    own = documents(docs, key, text)
    own = own.select("doc_id", "text", *_draw(seed))
    giant = F.octet_length("text") > block
    done = _within(own.where(~giant), unit).unionByName(_dealt(own.where(giant), unit, block))
    form = F.when((F.col("n") == 0) | (F.col("text") == "") | F.col("marked") | (F.col("h3") % 100 >= 100 - plain_percent), "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    raw = F.col("text").cast("binary")
    cut = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    prefix, middle, suffix = cut(F.lit(0), F.col("b1")), cut(F.col("b1"), F.col("b2")), cut(F.col("b2"), F.octet_length("text").cast("long"))
    output = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.col("text"))
    made = done.withColumn("form", form).select(
        "doc_id", "n", "form", F.when(F.col("form") != "plain", F.col("c1")).alias("prefix_units"), F.when(F.col("form") != "plain", F.col("c2") - F.col("c1")).alias("middle_units"), output.alias("output")
    )
    return made.withColumn("restored", restored("output", "form"))


def restored(output: str, form: str) -> Column:
    """The text that an output of a form was made from."""
    parts = F.split(F.col(output), "|".join(re.escape(m) for m in (PREFIX, SUFFIX, MIDDLE)), -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(F.col(form) == "psm", F.concat(part(1), part(3), part(2))).when(F.col(form) == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.col(output))
