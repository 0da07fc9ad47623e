"""Hashes of all windows of a text, computed in numpy without a loop over positions."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def codes(text: str) -> np.ndarray:
    """Code points of a text (lone surrogates included)."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up), np.cumprod(down))
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits (finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def window_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each window of ``k`` points; the same window has the same hash at any place."""
    n = len(points)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = _powers_to(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(0x1234567)) * up, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least value of each ``w`` consecutive ones, by doubling."""
    out, have = h, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least values of all runs of ``w`` consecutive values (all of equal ones).

    Any ``w`` consecutive positions hold at least one chosen one. A value is chosen exactly if the
    greatest of the run minima over the runs that hold it is the value itself.
    """
    if len(h) == 0:
        return np.empty(0, np.int64)
    if len(h) <= w:
        return np.flatnonzero(h == h.min())
    low = sliding_min(h, w)
    padded = np.concatenate([np.zeros(w - 1, h.dtype), low, np.zeros(w - 1, h.dtype)])
    top = ~sliding_min(~padded, w)
    return np.flatnonzero(top == h)
