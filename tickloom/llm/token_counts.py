"""Token counts by prefix dynamic programming.

The count at a prefix is the count at the last chunk end before it plus that of
the cut chunk. A dynamic program over the bytes of each distinct word gives the counts of
all of its prefixes from shorter ones, in time linear in the word. One pass gives the exact
count at every stored prefix: at every character, or at the ends of chunks only. Stored counts then answer "how many
tokens are the first n bytes" and "how much text fits in a budget" without
encoding again: exactly at any character with every="char", and at the last end of
a chunk with every="chunk".

Nulls and empty texts have zero tokens. Rows that repeat are counted each by
itself. Extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import wordtokens
from tickloom.llm.common import SPACE, documents, joined, slices, tokenizer_chunks

SCHEMA = "doc_id long, n_bytes long, prefix_end array<int>, prefix_tokens array<int>"


def prefix_counts(docs: DataFrame, tokenizer: str, every: str = "chunk", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Exact token counts at every prefix of each text.

    ``tokenizer``: path of a tokenizers file whose tokens never cross white space.
    ``every``: "chunk" stores the prefixes that end where a run of non-space
    characters ends, "char" stores those that end at any character of such a run.
    White space adds no token, so every other prefix has the count of the one before.
    Columns: doc_id, n_bytes, prefix_end (bytes, ascending), prefix_tokens.
    """
    if every not in ("chunk", "char"):
        raise ValueError("every is 'chunk' or 'char'")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = wordtokens.load(tokenizer)
        for part in slices(batches, limit=wordtokens.SLICE_BYTES):
            texts = part.column("text")
            ends, tokens, at = _prefixes(own, texts, every)
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (ends, tokens)]
            sizes = pa.array([len(x) for x in texts.cast(pa.binary()).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, *lists], names=["doc_id", "n_bytes", "prefix_end", "prefix_tokens"])

    return documents(docs, key, text).mapInArrow(count, SCHEMA)


def _prefixes(own: wordtokens.WordTokens, texts: pa.Array, every: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ends of the stored prefixes of each text, their tokens, and offsets of texts into both."""
    chunks = tokenizer_chunks(texts)
    coded = chunks.values.dictionary_encode()
    codes = coded.indices.to_numpy()
    counts = own.prefix_bytes(coded.dictionary.to_pylist())
    bound = np.concatenate([[0], np.cumsum(np.fromiter((len(c) // 4 for c in counts), np.int64, len(counts)))])
    values = np.frombuffer(b"".join(counts), np.int32)
    # what the chunks of a text before each one come to
    each = values[bound[1:] - 1][codes].astype(np.int64) if len(codes) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(each)])
    per_doc = np.diff(chunks.offsets)
    before = total[:-1] - np.repeat(total[chunks.offsets[:-1]], per_doc)
    if every == "chunk":
        return chunks.ends - np.repeat(chunks.begin[:-1], per_doc), before + each, chunks.offsets
    spread = pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(values)).take(coded.indices).flatten().to_numpy()
    raw, begin = joined(texts)
    # a character ends where no byte that continues one follows
    last = np.ones(len(raw), bool)
    last[:-1] = (raw[1:] & 0xC0) != 0x80
    ends = np.flatnonzero(last & ~SPACE[raw]) + 1
    at = np.searchsorted(ends, begin, side="right")
    tokens = spread + np.repeat(before, np.diff(bound)[codes])
    return ends - np.repeat(begin[:-1], np.diff(at)), tokens, at


def n_tokens() -> Column:
    """Tokens of the whole text, from the stored prefixes."""
    return F.when(F.size("prefix_tokens") == 0, F.lit(0)).otherwise(F.element_at("prefix_tokens", -1)).cast("long")


def tokens_at(n_bytes: Column) -> Column:
    """Tokens of the last stored prefix that ends within the first ``n_bytes`` bytes."""
    k = F.size(F.filter("prefix_end", lambda e: e <= n_bytes))
    return F.when(k == 0, F.lit(0)).otherwise(F.element_at("prefix_tokens", F.greatest(k, F.lit(1)))).cast("long")


def fits_in(budget: Column) -> Column:
    """Bytes of the longest stored prefix of at most ``budget`` tokens.

    A longer prefix may have fewer tokens than a shorter one, so all are looked at.
    """
    fitting = F.filter("prefix_end", lambda e, i: F.get("prefix_tokens", i) <= budget)
    return F.coalesce(F.array_max(fitting), F.lit(0)).cast("long")
