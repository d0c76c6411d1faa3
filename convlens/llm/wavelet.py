"""A wavelet matrix over small alphabets: ranks in a constant number of steps, by numpy for many places at once."""

from __future__ import annotations

import numpy as np

WORD = 64


class Bits:
    """A bit vector in words of 64, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // WORD + 1) * WORD, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = n - int(self.before[-1])

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Ones before each place, which may be the length."""
        word, bit = place // WORD, (place % WORD).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)


class WaveletMatrix:
    """Levels from the highest bit down; each level is stably parted by the bit of the one before, zeros first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(symbols), bits, []
        now = symbols
        for level in range(bits - 1, -1, -1):
            bit = (now >> level) & 1
            self.levels.append(Bits(bit))
            now = np.concatenate([now[bit == 0], now[bit == 1]]) if level else now

    def rank(self, symbol: int, place: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before each place."""
        lo, hi = np.zeros_like(place), place
        for level, own in zip(range(self.bits - 1, -1, -1), self.levels):
            low, high = own.rank(lo), own.rank(hi)
            lo, hi = (own.zeros + low, own.zeros + high) if symbol >> level & 1 else (lo - low, hi - high)
        return hi - lo

    def count(self, symbols: tuple[int, ...], place: np.ndarray) -> np.ndarray:
        """Occurrences of any of ``symbols`` before each place."""
        return sum(self.rank(s, place) for s in symbols)

    def locate(self, symbols: tuple[int, ...], nth: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The last place in lo..hi before which there are at most ``nth`` of ``symbols``: that of the one numbered nth from 0, or hi
        where there is none. By bisection on ranks, for all at once."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            middle = (lo + hi + 1) // 2
            enough = self.count(symbols, middle) <= nth
            lo = np.where(open_ & enough, middle, lo)
            hi = np.where(open_ & ~enough, middle - 1, hi)
        return lo
