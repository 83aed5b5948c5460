"""Polynomial rolling hashes modulo 2**64 over words and word sequences."""

from __future__ import annotations

import numpy as np

from tickloom.llm.common import mix64

#: Bases of the two rolling hashes (odd numbers, fixed values).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        _powers[base] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, x, np.uint64)])) for x in (base, pow(base, -1, 1 << 64)))
    return _powers[base]


def rolling(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values times powers of the base."""
    up, _ = _power(base, len(values))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])


def between(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the values between positions."""
    _, down = _power(base, len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of the bytes of each word."""
    return between(rolling(raw.astype(np.uint64) + np.uint64(1), base), starts, ends, base)
