"""Vectorised tokenising and hashing over UTF-8 bytes with numpy."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

#: Byte classes: 0 separates, 1 belongs to a word (digits, letters, all above ASCII), 2 is punctuation.
WORDS = np.zeros(256, np.uint8)
WORDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
WORDS_AND_MARKS = WORDS.copy()
WORDS_AND_MARKS[[x for x in range(33, 127) if not WORDS[x]]] = 2
_SAME = np.arange(256, dtype=np.uint8)
LOWER = _SAME.copy()
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit (the splitmix64 steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 1 << 22:
            _powers[name] = have
    return have[:n]


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = WORDS, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(document of each token from 0, 64-bit hash of each token) of the documents data[offsets[i]:offsets[i+1]].

    A token is a maximal run of bytes of one class other than 0 in one document.
    """
    base, end = int(offsets[0]), int(offsets[-1])
    data = data[base:end]
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    kinds = classes[data]
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:n])
    change[offsets - base] = True
    at = np.flatnonzero(change)
    starts, ends = at[:-1], at[1:]
    keep = kinds[starts] != 0
    starts, ends = starts[keep], ends[keep]
    if lower:
        data = LOWER[data]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power("down", _INVERSE, n)[starts])
    owner = np.searchsorted(offsets - base, starts, "right") - 1
    return owner, hashes
