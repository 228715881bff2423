"""A compressed FM-index over a sequence of integers, searched for many patterns at once.

The Burrows-Wheeler transform is held in a wavelet matrix whose levels are packed bits with a running count per 64 bits.
Suffixes are sorted on their first symbols up to a depth; searches no longer than that depth are exact.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ONE = _U(1)


class Bits:
    """Packed bits with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int32)
        self.zeros = int(len(bits) - np.count_nonzero(bits))

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many ones lie before each place."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((_ONE << (i & 63).astype(_U)) - _ONE))


class FMIndex:
    """text: integers from 0 to sigma - 1."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        text = np.asarray(text, np.int64)
        self.n, self.sigma = len(text), sigma
        order = self._suffixes(text, depth)
        last = text[order - 1]  # the transform; the first suffix is preceded by the last symbol
        self.levels = []
        now = last
        for level in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (now >> level) & 1
            self.levels.append((level, Bits(bit)))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        counts = np.bincount(text, minlength=sigma)
        self.first = np.concatenate([[0], np.cumsum(counts)])[:sigma]
        self.shift = self.first - self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    @staticmethod
    def _suffixes(text: np.ndarray, depth: int) -> np.ndarray:
        """Order of the suffixes, taken round, by their first symbols up to depth or more, by doubling."""
        rank, n, size = text, len(text), 1
        while True:
            if size > 1:
                rank = rank * (int(rank.max()) + 1) + np.roll(rank, -(size // 2))
            order = np.argsort(rank, kind="stable")
            ahead = rank[order]
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(ahead[1:] != ahead[:-1])]) if n else 0
            rank = new
            if size >= depth or not n or rank.max() == n - 1:
                return order
            size *= 2

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol >> level) & 1, bits.zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with a symbol put before each."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.concatenate([self.shift[symbol]] * 2)
        return both[: len(symbol)], both[len(symbol) :]

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, most: np.ndarray | int, least: int = 2) -> np.ndarray:
        """For each end, the length (at most `most`) of the longest stretch text[..end] that occurs at least `least` times."""
        ends = np.asarray(ends, np.int64)
        length = np.zeros(len(ends), np.int64)
        limit = np.broadcast_to(most, ends.shape)
        alive = np.flatnonzero(limit > 0)
        lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        while len(alive):
            lo, hi = self.extend(text[ends[alive] - length[alive]], lo, hi)
            good = hi - lo >= least
            alive, lo, hi = alive[good], lo[good], hi[good]
            length[alive] += 1
            more = length[alive] < limit[alive]
            alive, lo, hi = alive[more], lo[more], hi[more]
        return length
