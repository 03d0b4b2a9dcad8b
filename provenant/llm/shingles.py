"""Word shingles of a text as 64-bit hashes, worked out on its bytes with numpy."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A random 64-bit value for each byte, from a rule.
_VALUE = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if size <= 1 << 22:
            _powers[name] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash a word, in order. Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[_LOWER[data]] * _power("step", _STEP, len(data)), out=total[1:])
    return mix64((total[ends] - total[starts]) * _power("back", _BACK, len(data))[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, width: int = 4) -> np.ndarray:
    """The distinct shingles of `width` words, as sorted 64-bit hashes; with fewer words, the whole sequence as one; none without words."""
    words = word_hashes(text or "")
    n = len(words)
    if not n:
        return words
    take = min(width, n)
    out = np.full(n - take + 1, take, np.uint64)
    for i in range(take):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + words[i : n - take + 1 + i])
    return np.unique(out)
