"""Pieces of texts under the byte-level pattern, cut by array operations.

The pattern takes contractions, runs of letters, of digits and of other signs
(each with one space before it, if there is one), and white space, all but the
last character of which stays apart from what follows. Every character belongs
to a piece, so pieces are given by where they start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tickloom.llm.common import joined

#: The pattern that ``cut`` follows (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_OTHER, _LETTER, _DIGIT, _SPACE = range(4)
_table: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The class of every code point."""
    if not _table:
        import regex

        every = "".join(map(chr, range(0x110000)))
        table = np.full(len(every), _OTHER, np.uint8)
        for kind, name in ((_LETTER, "L"), (_DIGIT, "N"), (_SPACE, "White_Space")):
            for m in regex.finditer(rf"\p{{{name}}}+", every):
                table[m.start() : m.end()] = kind
        _table.append(table)
    return _table[0]


def _starts(code: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where pieces start, as marks on code points; ``begin``: where texts start, and the end."""
    kind = _classes()[code]
    first = np.zeros(len(code) + 3, bool)
    first[begin] = True
    first[len(code) :] = True
    start = first[: len(code)].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last of several white-space characters stays apart, and a space joins what follows
    after = np.flatnonzero(start[1:] & ~first[1 : len(code)] & (kind[1:] != _SPACE) & (kind[:-1] == _SPACE)) + 1
    start[after - 1] = True
    start[after[code[after - 1] == 32]] = False
    # contractions
    at = np.flatnonzero((code == 39) & start)
    at = at[~first[at + 1]]
    wide = np.append(code, np.zeros(2, code.dtype))
    one, two = wide[at + 1], wide[at + 2]
    is_ = lambda x, letters: np.isin(x, [ord(c) for c in letters])
    pair = ((is_(one, "rv") & is_(two, "e")) | (is_(one, "l") & is_(two, "l"))) & ~first[at + 2]
    size = np.where(is_(one, "stmd"), 1, np.where(pair, 2, 0))
    at, size = at[size > 0], size[size > 0]
    start[at + 1] = False
    end = at + 1 + size
    end = end[end < len(code)]
    start[end[kind[end] == _LETTER]] = True
    return start


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces (binary) of a string column without nulls, and the offsets of texts into them."""
    raw, begin = joined(texts)
    if not len(raw):
        return pa.array([], pa.binary()), np.zeros(len(begin), np.int64)
    code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    starts = at[_starts(code, np.searchsorted(at, begin))]
    bounds = np.append(starts, len(raw)).astype(np.int64)
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))])
    return values, np.searchsorted(starts, begin)
