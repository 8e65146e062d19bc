"""Hashes of many spans of one flat code-point or byte array at once, and a numpy hash index over them.

A span's hash is a difference of prefix sums of a polynomial, scaled back to position 0, so the cost
does not depend on how long spans are or how they overlap. Two independent 64-bit hashes identify a span.
Sums are taken over windows of about WINDOW symbols, so memory does not grow with the array.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: odd bases and their inverses modulo 2**64
_BASES = [(b, pow(b, -1, 1 << 64)) for b in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)]
_powers: list[np.ndarray] = []
WINDOW = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> list[np.ndarray]:
    """Powers of the bases and of their inverses; those of up to two windows are kept."""
    global _powers
    if not _powers or len(_powers[0]) < n:
        size, made = max(n, WINDOW + WINDOW // 8 + 2), []
        for pair in _BASES:
            for base in pair:
                p = np.full(size, base, _U)
                p[0] = 1
                made.append(np.cumprod(p, dtype=_U))
        if size > 2 * WINDOW + 2:
            return made  # one span is that long
        _powers = made
    return _powers


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, two: bool = True) -> list[np.ndarray]:
    """One or two 64-bit hashes of values[start:end] for every span; equal contents hash alike everywhere."""
    if len(values) <= WINDOW + WINDOW // 8:
        return _hashes(values, starts, ends, two)
    out = [np.empty(len(starts), _U) for _ in range(1 + two)]
    order = np.argsort(starts, kind="stable")
    starts, ends, a = starts[order], ends[order], 0
    while a < len(starts):
        lo = int(starts[a])
        c = a + max(1, int(np.searchsorted(starts[a:], lo + WINDOW // 2)))
        hi = int(ends[a:c].max())
        for o, h in zip(out, _hashes(values[lo:hi], starts[a:c] - lo, ends[a:c] - lo, two)):
            o[order[a:c]] = h
        a = c
    return out


def _hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, two: bool) -> list[np.ndarray]:
    n = len(values)
    powers = _power(n + 1)
    # symbols become 64-bit values; the length tells apart spans that differ by leading symbols only
    symbol = (values.astype(_U) + _U(1)) * _U(0xA0761D6478BD642F)
    symbol ^= symbol >> _U(29)
    out = []
    for k in range(1 + two):
        sums = np.zeros(n + 1, _U)
        np.cumsum(symbol * powers[2 * k][:n], out=sums[1:], dtype=_U)
        h = (sums[ends] - sums[starts]) * powers[2 * k + 1][starts]
        out.append(mix(h + (ends - starts).astype(_U) * _U(0xE7037ED1A0B428DB)))
    return out


class SpanIndex:
    """Open-addressing index from pairs of 64-bit hashes to dense codes 0, 1, 2 and so on."""

    def __init__(self, bits: int = 17):
        self.n, self.bits = 0, bits
        self._alloc()

    def _alloc(self) -> None:
        size = 1 << self.bits
        self.k1, self.k2, self.code = np.zeros(size, _U), np.zeros(size, _U), np.full(size, -1, np.int32)

    def _slot(self, k1: np.ndarray) -> np.ndarray:
        return (k1 >> _U(64 - self.bits)).astype(np.int64)

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Codes, -1 for what is not in the index."""
        slot = self._slot(k1)
        code = self.code[slot].astype(np.int64)
        open_ = np.flatnonzero((code >= 0) & ((self.k1[slot] != k1) | (self.k2[slot] != k2)))
        while len(open_):
            at = slot[open_] = (slot[open_] + 1) & (len(self.code) - 1)
            got = self.code[at]
            code[open_] = got
            open_ = open_[(got >= 0) & ((self.k1[at] != k1[open_]) | (self.k2[at] != k2[open_]))]
        return code

    def add(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Add distinct pairs that are not in the index; they get the next codes in order."""
        codes = np.arange(self.n, self.n + len(k1), dtype=np.int32)
        self.n += len(k1)
        if self.n * 5 > 2 << self.bits:
            used = self.code >= 0
            k1, k2, codes = (np.concatenate([a[used], b]) for a, b in ((self.k1, k1), (self.k2, k2), (self.code, codes)))
            while self.n * 5 > 2 << self.bits:
                self.bits += 1
            self._alloc()
        slot = self._slot(k1)
        while len(k1):
            free = np.flatnonzero(self.code[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            one = free[one]
            self.k1[slot[one]], self.k2[slot[one]], self.code[slot[one]] = k1[one], k2[one], codes[one]
            rest = np.ones(len(k1), bool)
            rest[one] = False
            k1, k2, codes, slot = k1[rest], k2[rest], codes[rest], (slot[rest] + 1) & (len(self.code) - 1)
