"""Words of UTF-8 byte arrays and their 64-bit hashes, for whole batches at once.

A word is a maximal run of bytes of a class; A-Z are lower-cased first.  Both word classes used here
put every byte from 0x80 on into words, so runs of bytes are runs of characters.
"""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z: digits, a-z and everything beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = True
ALNUM[128:] = True

#: [^\x20\x09-\x0D]
NON_SPACE = np.ones(256, bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, 2 * len(_powers["up"]), 1 << 16)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


class Words:
    """Words of a slice of documents: spans in ``low``, the row of each, and first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        base = int(offsets[0])
        self.offsets = offsets - base
        self.low = low = _LOWER[data[base : int(offsets[-1])]]
        inside = kind[low]
        edge = np.zeros(len(low) + 1, bool)
        edge[self.offsets] = True  # a row's first byte never continues the row before
        before = np.empty(len(low), bool)
        if len(low):
            before[0] = False
            before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(low), bool)
        if len(low):
            after[-1] = False
            after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)  # n + 1 entries
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        up, down = _power(len(self.low) + 1)
        sums = np.zeros(len(self.low) + 1, np.uint64)
        np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * up[: len(self.low)], dtype=np.uint64, out=sums[1:])
        own = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix(own + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def grams(words: np.ndarray, k: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Hash of the k words from each start, by default all with k words to come (rows not regarded)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy() if starts is None else words[starts]
    for i in range(1, k):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += words[i : i + n] if starts is None else words[starts + i]
    return mix(out + np.uint64(k * 0x165667B19E3779F9 & _MASK))
