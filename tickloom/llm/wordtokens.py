"""Ids of whole texts under a tokenizers file whose tokens never cross white space.

The tokenizer drops white space and splits there before any merge, so the ids
of a text are the ids of its chunks between white space, one after another.
Each batch therefore hands the library its distinct chunks only.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from tickloom.llm.common import tokenizer_chunks

#: Bytes of text encoded at a time: the more, the fewer repeated look-ups of chunks.
SLICE_BYTES = 4 << 20
#: Chunks after which a Python worker forgets those it has not met since as many before.
REMEMBERED = 400_000
#: Words of letters that the library gets as one line.
LINE = 64
#: Characters of the longest chunk whose prefix counts are remembered.
SHORT = 64
#: Last characters by which tokens are looked up.
LAST = 3

_loaded: dict[str, "WordTokens"] = {}


class Encoded(NamedTuple):
    """Ids of a batch: ``ids`` back to back, ``offsets`` of documents into them,
    ``chunk_ends`` byte ends of chunks in their text, ``chunk_tokens`` tokens up to
    there, ``chunk_offsets`` of documents into both."""

    ids: np.ndarray
    offsets: np.ndarray
    chunk_ends: np.ndarray
    chunk_tokens: np.ndarray
    chunk_offsets: np.ndarray


class WordTokens:
    """A tokenizers file and the chunks it has lately encoded."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        ids = lambda t: self.library.encode(t, add_special_tokens=False).ids
        if ids("Aa, B.") != ids("aa") + ids(",") + ids("b") + ids("."):
            raise ValueError("the tokenizer must lower-case, drop white space and part marks from words")
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        # which tokens end a word, so that ids of a line part into those of its words
        model = json.loads(self.library.to_str())["model"]
        suffix, self.ends = model.get("end_of_word_suffix"), np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for t, i in model["vocab"].items() if suffix and t.endswith(suffix)]] = True
        self.prefixes: Prefixes | None = None
        self.counted: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk as little-endian bytes."""
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = {c: self._parts(c) for c in chunks if c not in known and not (c in before and known.setdefault(c, before[c]))}
        words = [w for w in dict.fromkeys(w for parts in new.values() for w in parts) if w not in known]
        known |= {w: before[w] for w in words if w in before}
        self._add([w for w in words if w not in before])
        known |= {c: b"".join([known[w] for w in parts]) for c, parts in new.items()}
        return [known[c] for c in chunks]

    def _parts(self, chunk: str) -> tuple[str, ...]:
        """Strings with the same ids as a chunk: lower case changes no id of an ASCII
        chunk, and a mark after an ASCII letter only starts a token of its own. Other
        letters may change under the tokenizer's normaliser, so their chunks stay whole."""
        if chunk[-1:] in (",", ".") and chunk[:-1].isascii() and chunk[:-1].isalpha():
            return (chunk[:-1].lower(), chunk[-1])
        return (chunk.lower() if chunk.isascii() and chunk.isalpha() else chunk,)

    def _add(self, words: list[str]) -> None:
        for begin in range(0, len(words), 20_000):
            part = words[begin : begin + 20_000]
            letters = [w for w in part if w.isascii() and w.isalpha()]
            if self._add_lines(letters):
                part = [w for w in part if not (w.isascii() and w.isalpha())]
            for w, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)):
                self.known[w] = struct.pack(f"<{len(e.ids)}{self.code}", *e.ids)

    def _add_lines(self, words: list[str]) -> bool:
        """Encode words of letters, many to a line; False if the ids do not part into as many words."""
        lines = [" ".join(words[i : i + LINE]) for i in range(0, len(words), LINE)]
        each = [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate(each) if each else np.zeros(0, self.dtype)
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) != len(words):
            return False
        raw, at = ids.tobytes(), (at * self.dtype.itemsize).tolist()
        self.known |= {w: raw[a:b] for w, a, b in zip(words, [0, *at], at)}
        return True

    def prefix_counts(self, chunk: str) -> list[int]:
        """Tokens of each prefix of a chunk, by characters."""
        if self.prefixes is None:
            self.prefixes = Prefixes(self.library)
        return self.prefixes.counts(chunk)

    def prefix_bytes(self, chunks: list[str]) -> list[bytes]:
        """Tokens of each prefix of each chunk as 32-bit integers; short chunks are remembered."""
        if len(self.counted) > REMEMBERED // 2:
            self.counted, self.older = {}, self.counted
        counted, older = self.counted, self.older
        counted |= {c: older[c] for c in chunks if c in older}
        # in order, so that a word goes on from the start it shares with the one before
        new = {c: np.array(self.prefix_counts(c), np.int32).tobytes() for c in sorted(c for c in chunks if c not in counted)}
        counted |= {c: n for c, n in new.items() if len(c) <= SHORT}
        return [counted[c] if c in counted else new[c] for c in chunks]

    def encode(self, texts: pa.Array, with_ids: bool = True) -> Encoded:
        """Encode whole texts (no nulls)."""
        chunks = tokenizer_chunks(texts)
        offsets = chunks.offsets
        coded = chunks.values.dictionary_encode()
        codes = coded.indices.to_numpy()
        known = self.chunks(coded.dictionary.to_pylist())
        width = np.fromiter((len(k) for k in known), np.int64, len(known)) // self.dtype.itemsize
        lens = width[codes]
        total = np.concatenate([[0], np.cumsum(lens)])
        per_doc = np.diff(offsets)
        chunk_ends = chunks.ends - np.repeat(chunks.begin[:-1], per_doc)
        chunk_tokens = total[1:] - np.repeat(total[offsets[:-1]], per_doc)
        ids = np.zeros(0, self.dtype)
        if with_ids and total[-1]:
            # taking whole chunks copies their ids one after another
            ids = np.frombuffer(pa.array(known, pa.binary()).take(coded.indices).buffers()[2], self.dtype, int(total[-1]))
        return Encoded(ids, total[offsets], chunk_ends, chunk_tokens, offsets)


def _joins(c: str, before: str) -> bool:
    """Whether a character may change under the normaliser with those before it: marks, Hangul vowels and finals, runs of spaces."""
    return c > "\x7f" and (unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff" or (c.isspace() and before.isspace()))


def _shared(a: str, b: str) -> int:
    """Characters at the start that two strings share."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


class Prefixes:
    """Counts of tokens at every prefix of a chunk, from the merges of a tokenizers model.

    A chunk parts into words (the tokenizer's own normaliser and splitter say how), and
    those of a prefix are the same but for the last, which is cut. Within a word of bytes, tokens
    follow each other in an encoding exactly if each two neighbours, taken alone, encode
    to themselves. So the last token of a prefix is the one that fits the encoding of what is
    before it, and a prefix has one token more than that. The token that ends a prefix carries
    the mark of a word's end; the ones inside do not.
    """

    def __init__(self, library) -> None:
        model = json.loads(library.to_str())["model"]
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        added = library.get_added_tokens_decoder().values()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens must be plain strings of the text")
        self.added = re.compile("|".join(sorted((re.escape(t.content) for t in added), key=len, reverse=True)) or "(?!)")
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.vocab = model["vocab"]
        # tokens inside and at the end of a word: whether they fit (token before, token), and lengths by last characters
        self.inside = ("", {t for t in self.vocab if not self.end or not t.endswith(self.end)}, {}, {})
        self.ending = (self.end, {t.removesuffix(self.end) for t in self.vocab if t.endswith(self.end)}, {}, {})
        for _, tokens, _, lengths in (self.inside, self.ending):
            for t in tokens:
                if len(t) >= LAST:
                    lengths.setdefault(t[-LAST:], set()).add(len(t))
            for tail, n in lengths.items():
                lengths[tail] = sorted(n | {k for k in range(1, LAST) if tail[-k:] in tokens}, reverse=True)
        self.words: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.single: dict[str, str] = {}
        self.state: tuple[str, list[str], list[int], list[int]] = ("", [""], [0], [])

    def _fit(self, a: str, b: str, end: str) -> bool:
        """Whether a (may be empty) and b, alone, encode to themselves; ``end`` closes b."""
        parts = [*a, *b[:-1], b[-1] + end]
        rank, none = self.rank.get, len(self.rank)
        while len(parts) > 1:
            ranks = [rank(p, none) for p in zip(parts, parts[1:])]
            least = min(ranks)
            if least == none:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts == [x for x in (a, b + end) if x]

    def _step(self, word: str, k: int, last: list[str], inner: list[int], kind: tuple) -> tuple[str, int]:
        """The last token of the first k bytes of a word, and the tokens there."""
        end, tokens, fits, lengths = kind
        tail = word[k - LAST : k] if k >= LAST else ""
        sizes = lengths.get(tail)
        if sizes is None:
            sizes = [n for n in range(min(k, LAST - 1), 0, -1) if word[k - n : k] in tokens]
            if tail:
                lengths[tail] = sizes
        for n in sizes:
            token = word[k - n : k]
            if n <= k and token in tokens:
                key = (last[k - n], token)
                fit = fits.get(key)
                if fit is None:
                    if len(fits) > REMEMBERED:
                        fits.clear()
                    fit = fits[key] = self._fit(*key, end)
                if fit:
                    return token, inner[k - n] + 1
        raise ValueError(f"no encoding of {word[:k]!r}")

    def word(self, word: str) -> list[int]:
        """Tokens of each prefix of a word of the splitter, by bytes; what it shares with the one before is not run again."""
        held = self.words.get(word) or self.older.get(word)
        if held:
            return held
        other, last, inner, out = self.state
        same = _shared(word, other)
        last, inner, out = last[: same + 1], inner[: same + 1], out[:same]
        for k in range(same + 1, len(word) + 1):
            out.append(self._step(word, k, last, inner, self.ending)[1])
            token, n = self._step(word, k, last, inner, self.inside)
            last.append(token)
            inner.append(n)
        self.state = (word, last, inner, out)
        if len(word) <= SHORT:
            if len(self.words) > REMEMBERED // 2:
                self.words, self.older = {}, self.words
            self.words[word] = out
        return out

    def counts(self, chunk: str) -> list[int]:
        """Tokens of each prefix of a chunk, by characters."""
        if chunk.isascii() and chunk.isalpha():
            return self.word(chunk.lower())
        out: list[int] = []
        at = done = 0
        for m in self.added.finditer(chunk):
            # until its last character an added token is text like any other
            part = self._plain(chunk[at : m.end() - 1])
            out += [done + n for n in part]
            done += 1 + (part[m.start() - at - 1] if m.start() > at else 0)
            out.append(done)
            at = m.end()
        return out + [done + n for n in self._plain(chunk[at:])]

    def _whole(self, text: str) -> int:
        """Tokens of a normalised text."""
        return sum(self.word(w)[-1] for w, _ in self.split(text))

    def _plain(self, text: str) -> list[int]:
        """Tokens of each prefix of a text without added tokens."""
        if not text:
            return []
        if text.isascii():
            return self._ascii(text.lower())
        # clusters: a character and those after it that may change with it
        bounds = [0, *[i for i in range(1, len(text)) if not _joins(text[i], text[i - 1])], len(text)]
        normal = [self._normal(text[a:b]) for a, b in zip(bounds, bounds[1:])]
        whole = "".join(normal)
        if self.normal(text) != whole:
            return [self._whole(self.normal(text[: k + 1])) for k in range(len(text))]
        words = self.split(whole)
        at, begins = [0] * (len(whole) + 1), list(range(len(whole) + 1))
        total = upto = 0
        for w, (a, b) in words:
            at[upto + 1 : a + 1] = [total] * (a - upto)
            counts, k = self.word(w), -1
            for i in range(a, b):
                k += len(whole[i].encode())
                at[i + 1], begins[i + 1] = total + counts[k], a
            if whole[a] == "'" and b - a == 3:
                # a contraction that is cut may be two words
                at[a + 2] = total + self._whole(whole[a : a + 2])
            total, upto = total + counts[-1], b
        at[upto + 1 :] = [total] * (len(whole) - upto)
        out, p = [], 0
        for a, b, c in zip(bounds, bounds[1:], normal):
            if b - a > 1:
                # a cut inside a cluster: the last word before it may go on with what is left of the cluster
                first = begins[p]
                if first and whole[first - 1] == "'":
                    first = begins[first]
                out += [at[first] + self._whole(whole[first:p] + self.normal(text[a:i])) for i in range(a + 1, b)]
            p += len(c)
            out.append(at[p])
        return out

    def _ascii(self, text: str) -> list[int]:
        """Tokens of each prefix of a text whose characters are bytes, in lower case."""
        out: list[int] = []
        total = 0
        for w, (a, b) in self.split(text):
            out += [total] * (a - len(out))
            counts = self.word(w)
            out += [total + n for n in counts] if total else counts
            if text[a] == "'" and b - a == 3:
                out[a + 1] = total + self._whole(text[a : a + 2])
            total += counts[-1]
        return out + [total] * (len(text) - len(out))

    def _normal(self, cluster: str) -> str:
        """A cluster as the normaliser leaves it."""
        if len(cluster) > 1:
            return self.normal(cluster)
        if cluster not in self.single:
            self.single[cluster] = self.normal(cluster)
        return self.single[cluster]


def load(path: str) -> WordTokens:
    """The tokenizer of a path, read once for each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]
