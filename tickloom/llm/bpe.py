"""Byte-level BPE by recursive SQL.

Each task cuts its texts into pieces by the tokenizer's pattern, takes the distinct
ones and lets DuckDB merge those it does not remember: token-position rows join the
merge table, and each round contracts the leftmost pair of least rank in every word
until no pair is left. Ids of a document are those of its pieces in order. Decoding
starts from the ids alone: they join the token table, and an ordered aggregation
puts the bytes of each document together.

A recursive query takes a round for each merge of its longest word, and each round
reads the whole word. Pieces of more than LONG bytes (runs of letters or signs without
a space) are therefore contracted in the same order from a heap of their pairs.

Nulls and empty texts have no ids. Rows that repeat are encoded each by itself.
Extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import pieces
from tickloom.llm.common import as_bytes, documents, give_back, slices

#: Bytes of text encoded at a time.
SLICE_BYTES = 1 << 19
#: Pieces after which a Python worker forgets those not met since as many before.
REMEMBERED = 100_000
#: New pieces, and bytes of them, that one recursive query takes on; it holds its rows of all rounds.
PIECES, PIECE_BYTES = 4_000, 50_000
#: Bytes above which a piece is contracted from a heap.
LONG = 64

_loaded: dict[tuple[str, str], "RecursiveBpe"] = {}

_MERGE = """
WITH RECURSIVE step(word, round, pos, tok, next_pos, next_tok) AS (
    SELECT word, 0, pos, tok, next_pos, next_tok FROM start
  UNION ALL
    SELECT s.word, s.round + 1, s.pos,
           CASE WHEN s.pos = b.pos THEN b.id ELSE s.tok END,
           CASE WHEN s.pos = b.pos THEN b.then_pos ELSE s.next_pos END,
           CASE WHEN s.pos = b.pos THEN b.then_tok WHEN s.next_pos = b.pos THEN b.id ELSE s.next_tok END
    FROM step s JOIN (
        SELECT l.word, l.pos, l.next_pos, CAST(f.best // 4294967296 AS INTEGER) AS id, r.next_pos AS then_pos, r.next_tok AS then_tok
        FROM (
            SELECT s.word, min(CAST(m.id AS BIGINT) * 4294967296 + s.pos) AS best
            FROM step s JOIN merges m ON m.a = s.tok AND m.b = s.next_tok
            GROUP BY s.word
        ) f
        JOIN step l ON l.word = f.word AND l.pos = f.best % 4294967296
        JOIN step r ON r.word = f.word AND r.pos = l.next_pos
    ) b ON b.word = s.word
    WHERE s.pos <> b.next_pos
)
SELECT word, list(tok ORDER BY pos) AS ids
FROM step JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) USING (word, round)
GROUP BY word
"""

_DECODE = "SELECT word, list(t.bytes ORDER BY pos) AS parts FROM coded JOIN tokens t USING (id) GROUP BY word"


class RecursiveBpe:
    """A rank file in DuckDB, and the pieces lately encoded with it."""

    def __init__(self, ranks: str, pattern: str) -> None:
        import duckdb
        import regex

        self.find = None if pattern == pieces.PATTERN else regex.compile(pattern).findall
        lines = [line.split() for line in Path(ranks).read_bytes().splitlines() if line.strip()]
        self.vocab = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.dtype = np.dtype("<u2") if max(self.vocab.values()) < 1 << 16 else np.dtype("<i4")
        self.single = np.array([self.vocab.get(bytes([b]), -1) for b in range(256)], np.int32)
        # nothing spills to a disk that other machines don't see
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": "", "preserve_insertion_order": False})
        merges = [(self.vocab[t[:k]], self.vocab[t[k:]], i) for t, i in self.vocab.items() for k in range(1, len(t)) if t[:k] in self.vocab and t[k:] in self.vocab]
        a, b, id_ = (np.array(c, np.int32) for c in zip(*merges))
        self._table("merges", {"a": a, "b": b, "id": id_})
        self._table("tokens", {"id": np.array(list(self.vocab.values()), np.int32), "bytes": pa.array(list(self.vocab), pa.binary())})
        # a byte without a rank is in no pair, as nothing longer than all tokens is one
        self.bytes_of = dict(zip(self.vocab.values(), self.vocab)) | {-1: bytes(1 + max(map(len, self.vocab)))}
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("held", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM held")
        self.db.unregister("held")

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each piece. A piece that is itself a token is that token."""
        pack = lambda ids: np.array(ids, self.dtype).tobytes()
        out = [pack([self.vocab[w]]) if w in self.vocab else pack(self._heaped(w)) if len(w) > LONG else b"" for w in words]
        todo = [k for k, o in enumerate(out) if not o and words[k]]
        if todo:
            sizes = np.array([len(words[k]) for k in todo])
            ends = np.cumsum(sizes)
            tokens = self.single[np.frombuffer(b"".join([words[k] for k in todo]), np.uint8)]
            pos = (np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)).astype(np.int32)
            last = np.zeros(ends[-1], bool)
            last[ends - 1] = True
            after = np.append(tokens[1:], 0).astype(np.int32)
            self.db.register("start", pa.table({"word": np.repeat(np.arange(len(todo), dtype=np.int32), sizes), "pos": pos, "tok": tokens, "next_pos": pa.array(pos + 1, mask=last), "next_tok": pa.array(after, mask=last)}))
            found = self.db.sql(_MERGE).to_arrow_table()
            self.db.unregister("start")
            lists = found.column("ids").combine_chunks()
            ids, bounds = lists.flatten().to_numpy().astype(self.dtype), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for word, a, b in zip(found.column("word").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                out[todo[word]] = ids[a:b].tobytes()
        return out

    def _heaped(self, word: bytes) -> list[int]:
        """Ids of a long piece: the leftmost pair of least rank first, as in the query."""
        rank_of, bytes_of, n = self.vocab.get, self.bytes_of, len(word)
        tok, before, after = self.single[np.frombuffer(word, np.uint8)].tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank, k, a, b) for k, (a, b) in enumerate(zip(tok, tok[1:])) if (rank := rank_of(bytes_of[a] + bytes_of[b])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at, a, b = heapq.heappop(heap)
            then = after[at]
            if tok[at] != a or then >= n or tok[then] != b:
                continue  # one of the two has been contracted
            tok[at], tok[then], after[at] = rank, -1, after[then]
            if after[at] < n:
                before[after[at]] = at
            for k in (before[at], at):
                if k >= 0 and after[k] < n and (rank := rank_of(bytes_of[tok[k]] + bytes_of[tok[after[k]]])) is not None:
                    heapq.heappush(heap, (rank, k, tok[k], tok[after[k]]))
        return [t for t in tok if t >= 0]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Bytes of each list of ids, by ordered aggregation; ``offsets``: bounds of the lists."""
        word = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
        self.db.register("coded", pa.table({"word": word, "pos": np.arange(len(ids), dtype=np.int32), "id": ids.astype(np.int32)}))
        try:
            found = self.db.sql(_DECODE).to_arrow_table()
        finally:
            self.db.unregister("coded")
        lists, words = found.column("parts").combine_chunks(), found.column("word").to_numpy()
        if pa.types.is_list(lists.type):
            lists = lists.cast(pa.large_list(pa.binary()))
        bytes_ = pc.binary_join(lists, pa.scalar(b"", pa.binary()))
        place = np.full(len(offsets) - 1, len(words), np.int64)  # what has no ids decodes to nothing
        place[words] = np.arange(len(words))
        return pa.concat_arrays([bytes_, pa.array([b""], bytes_.type)]).take(pa.array(place))

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each piece, remembered over two generations."""
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = []
        for w in words:
            if w not in known:
                if w in before:
                    known[w] = before[w]
                else:
                    new.append(w)
        begin = 0
        while begin < len(new):
            end, held = begin, 0
            while end < len(new) and end - begin < PIECES and (end == begin or held < PIECE_BYTES):
                held += len(new[end])
                end += 1
            known.update(zip(new[begin:end], self.merge(new[begin:end])))
            begin = end
        return [known[w] for w in words]

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of texts, and the offsets of texts into them."""
        if self.find is None:
            return pieces.cut(texts)
        lists = [self.find(t) for t in texts.to_pylist()]
        return pa.array([p.encode() for x in lists for p in x], pa.large_binary()), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts back to back, and the offsets of texts into them."""
        cut, offsets = self.cut(texts)
        coded = cut.dictionary_encode()
        packed = pa.array(self.encode(coded.dictionary.to_pylist()), pa.large_binary())
        width = pc.binary_length(packed).to_numpy(zero_copy_only=False) // self.dtype.itemsize
        total = np.concatenate([[0], np.cumsum(width[coded.indices.to_numpy()])]).astype(np.int64) if len(cut) else np.zeros(1, np.int64)
        # taking whole pieces copies their ids one after another
        ids = np.frombuffer(packed.take(coded.indices).buffers()[2], self.dtype, int(total[-1])) if total[-1] else np.zeros(0, self.dtype)
        return ids, total[offsets]


def load(ranks: str, pattern: str) -> RecursiveBpe:
    """The encoder of a rank file, made once for each Python worker."""
    if (ranks, pattern) not in _loaded:
        _loaded[ranks, pattern] = RecursiveBpe(ranks, pattern)
    return _loaded[ranks, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of whole texts and the bytes that those ids decode to.

    ``ranks``: path of a tiktoken rank file; ``pattern``: the expression that splits
    text before merging. Columns: doc_id, n_tokens, ids (decimal, joined by commas),
    decoded (binary).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(ranks, pattern)
        for part in slices(batches, limit=SLICE_BYTES):
            ids, offsets = own.texts(part.column("text"))
            lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(ids).cast(pa.string()))
            lines = pc.binary_join(lists, ",").cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), lines, own.decode(ids, offsets).cast(pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])
            give_back()

    return documents(docs, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded binary")


def decode(coded: DataFrame, ranks: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Bytes of ids (decimal, joined by commas; null: none): doc_id, decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(ranks, pattern)
        for part in slices(batches, column="ids"):
            lists = [[int(i) for i in line.split(b",") if i] for line in as_bytes(part.column("ids"))]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), own.decode(np.array([i for x in lists for i in x], np.int32), offsets).cast(pa.binary())], names=["doc_id", "decoded"])

    rows = coded.select(F.col(key).alias("doc_id"), F.coalesce(F.col(ids), F.lit("")).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, decoded binary")
