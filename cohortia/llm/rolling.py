"""Rabin-Karp fingerprints of all windows of a sequence by numpy prefix sums."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_U64 = np.uint64


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    steps = np.full(n, base, _U64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=_U64)


class Rolling:
    """Polynomial hashes modulo 2^64 of windows of ``values`` (unsigned
    64-bit): the value depends on the window alone, not on its place."""

    def __init__(self, values: np.ndarray):
        n = len(values) + 1
        falling = powers(pow(BASE, -1, 1 << 64), n)
        sums = np.cumsum(values * falling[:-1], dtype=_U64)
        self.sums = np.concatenate([np.zeros(1, _U64), sums])
        self.rising = powers(BASE, n)

    def windows(self, at: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        """Hashes of the ``n`` values (one or more) from each position."""
        value = (self.sums[at + n] - self.sums[at]) * self.rising[at + n - 1]
        return (value ^ (value >> _U64(29))) * _U64(BASE) + np.asarray(n).astype(_U64)
