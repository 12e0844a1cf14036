"""Sets of word shingles as 64-bit hashes, made from the bytes of a text without a loop over words."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grown(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse modulo 2**64, at least ``size`` of them."""
    global _powers, _inverses
    if len(_powers) < size:
        n = 1 << (size - 1).bit_length()
        inverse = np.uint64(pow(int(BASE), -1, 2**64))
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]), dtype=np.uint64)
        _inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)
    return _powers, _inverses


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (two rounds of multiply and shift)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """One hash per word, words being what ASCII white space separates."""
    data = np.frombuffer(text.encode(), np.uint8)
    space = SPACE[data]
    if not len(data) or space.all():
        return np.zeros(0, np.uint64)
    edges = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    return segment_hashes(data, starts, ends)


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start to its end."""
    powers, inverses = _grown(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * inverses[starts])


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct shingles of ``size`` words, sorted; a shorter text is one shingle, one without words none."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    places = max(1, len(words) - size + 1)
    total = np.full(places, np.uint64(min(size, len(words))))
    for j in range(min(size, len(words))):
        total = mixed(total + words[j : j + places])
    return np.unique(total)
