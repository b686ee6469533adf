"""Vectorised hashes of byte ranges, words and grams of many texts at once."""

from __future__ import annotations

import numpy as np

# Two odd multipliers for polynomial hashes modulo 2^64 and the mixer's constants.
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


#: Longest tables of powers that a worker keeps.
KEPT_POWERS = 1 << 21


class Prefixes:
    """Hashes of any byte range of one stretch, from prefix sums of a polynomial modulo 2^64."""

    _tables: dict[int, np.ndarray] = {}
    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int = 0):
        base = _BASES[which]
        if which not in self._tables:
            self._tables[which] = mixed(np.arange(1, 257, dtype=np.uint64) * base)
        up, down = self._powers.get(which, (np.ones(1, np.uint64), np.ones(1, np.uint64)))
        if len(up) < len(data) + 1:
            n = max(len(data) + 1, 2 * len(up), 1 << 16)
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (base, inverse))
            self._powers[which] = up, down
            if len(up) > KEPT_POWERS:  # of a very long stretch: not kept for the life of the worker
                self._powers.pop(which)
        self.down = down
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values = self._tables[which][data] if data.dtype == np.uint8 else mixed(data * base)
        np.cumsum(values * up[: len(data)], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((self.sums[hi] - self.sums[lo]) * self.down[lo] ^ (hi - lo).astype(np.uint64))

    def grams(self, n: int) -> np.ndarray:
        """Hashes of all ranges of ``n`` bytes."""
        at = len(self.sums) - n
        return mixed((self.sums[n:] - self.sums[:at]) * self.down[:at])


# Bytes that belong to words (ASCII letters and digits, and all of multi-byte letters).
WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD[_lo:_hi] = True
#: ASCII white space.
GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _ranges(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(of) + 2, np.int8)
    inside[1:-1] = of
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last places of the words in ``data``."""
    return _ranges(WORD[data])


def between_gaps(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last places of what ASCII white space parts in ``data``."""
    return _ranges(~GAP[data])


def apart(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a blank after each, so that no word spans two, and their new offsets."""
    n = len(offsets) - 1
    out = np.full(len(data) + n, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
    return out, offsets + np.arange(n + 1)
