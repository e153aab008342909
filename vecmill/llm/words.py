"""Words between ASCII white space, and 64-bit hashes of them and of their windows, as array operations."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Words hashed at a time.
CHUNK = 1 << 16
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64), one to one."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


@cache
def byte_values() -> np.ndarray:
    return np.random.default_rng(29).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def powers(n: int) -> np.ndarray:
    out = np.full(n, 0x9FB21C651E98DF25, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of [^\\x20\\x09-\\x0D]+; for each document its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes."""
    out = np.empty(len(starts), np.uint64)
    values = byte_values()
    for i in range(0, len(starts), CHUNK):
        s, size = starts[i : i + CHUNK], (ends - starts)[i : i + CHUNK]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        terms = values[data[np.repeat(s, size) + place]]
        terms *= powers(1 << int(size.max()).bit_length())[place]
        out[i : i + CHUNK] = np.add.reduceat(terms, first) + size.astype(np.uint64)
    return mix(out)


def windows(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A hash of each run of n word hashes: one for each start up to the n-th last word (documents aren't told apart here)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    factor = np.uint64(seed | 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= factor
        out += h[k : k + m]
    return mix(out)
