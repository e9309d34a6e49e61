"""Words of whole record batches and their 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# fixed values: odd multipliers of a polynomial over bytes and of two finishers
_P = 0x9E3779B97F4A7C15
_PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 0x10001)) | np.uint64(1)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _PIECE + 1)
        up, down = np.full(size, _P, np.uint64), np.full(size, pow(_P, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch: byte places, hashes, and where each row's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # n + 1 word positions

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, places: np.ndarray, space: np.ndarray = _SPACE) -> Words:
    """``space`` marks the bytes between words, if others than those above."""
    inside = ~space[data]
    rows = places[:-1][np.diff(places) > 0]
    joins = np.concatenate([[False], inside[:-1]])
    joins[rows] = False
    starts = np.flatnonzero(inside & ~joins)
    joins = np.concatenate([inside[1:], [False]])
    joins[rows[1:] - 1] = False
    ends = np.flatnonzero(inside & ~joins) + 1
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        at = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, at + _PIECE, "right")))
        size = int(ends[last - 1] - at)
        up, down = _tables(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((data[at : at + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
        low, high = starts[first:last] - at, ends[first:last] - at
        hashes[first:last] = mix((sums[high] - sums[low]) * down[low])
        first = last
    return Words(starts, ends, hashes, np.searchsorted(starts, places))


def runs(hashes: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A hash of every ``length`` consecutive words, rows not regarded."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, odd in enumerate(odd_numbers(length, seed)):
        out += hashes[i : i + n] * odd
    return mix(out)


def inside_row(first: np.ndarray, length: int) -> np.ndarray:
    """The word positions where ``length`` words of one row begin."""
    n = int(first[-1]) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    for back in range(1, length):  # the last positions of each row
        ends = first[1:] - back
        ok[ends[(ends >= 0) & (ends < n)]] = False
    return np.flatnonzero(ok)
