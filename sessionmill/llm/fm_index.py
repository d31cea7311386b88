"""A compressed full-text index over short passages of word numbers, in numpy.

Only the Burrows-Wheeler transform of the passages is kept, in a wavelet matrix: one bit vector for each
bit of a word number, with a count for every 64 bits. Neither the passages nor their suffix order stay.
Matching statistics come from backward search for all places of streamed passages at once.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        own = np.packbits(bits, bitorder="little")
        packed[: len(own)] = own
        self.blocks = packed.view(np.uint64)
        self.before = np.zeros(len(self.blocks), np.uint32)
        np.cumsum(np.bitwise_count(self.blocks[:-1]), out=self.before[1:], dtype=np.uint32)
        self.ones = int(self.before[-1] + np.bitwise_count(self.blocks[-1]))
        self.zeros = n - self.ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block].astype(np.int64) + np.bitwise_count(self.blocks[block] & below)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.levels: list[BitVector] = []
        for level in range(bits - 1, -1, -1):
            ones = (symbols >> level & 1).astype(bool)
            self.levels.append(BitVector(ones))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the places `at` come to when they follow the bits of their symbols."""
        for level, vector in enumerate(self.levels):
            one = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            ones = vector.rank(at)
            at = np.where(one, vector.zeros + ones, at - ones)
        return at


class FmIndex:
    """Index of passages: `symbols` are word numbers from 1 on, each passage ended by a 0."""

    def __init__(self, symbols: np.ndarray, longest: int):
        n = len(symbols)
        transformed = symbols[suffix_order(symbols, longest) - 1]
        self.counts = np.r_[0, np.cumsum(np.bincount(symbols))]  # symbols smaller than each
        bits = max(1, int(symbols.max()).bit_length()) if n else 1
        self.wavelet = WaveletMatrix(transformed, bits)
        kinds = np.arange(len(self.counts) - 1)
        self.base = self.counts[:-1] - self.wavelet.descend(kinds, np.zeros(len(kinds), np.int64))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the suffixes that start with symbol and go on as those in [lo, hi)."""
        base = self.base[symbol]
        return base + self.wavelet.descend(symbol, lo), base + self.wavelet.descend(symbol, hi)

    def matching_statistics(self, stream: np.ndarray, ends: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place of `stream`: the length of the longest stretch ending there that the index holds twice or more, and the first of its suffixes.

        Stretches are followed up to `limit` words; no stretch may reach over the beginning of its passage.
        """
        last = stream[ends]
        lo, hi = self.counts[last], self.counts[last + 1]
        length = np.minimum(hi - lo, 2) // 2
        live = np.flatnonzero(length)
        for n in range(1, limit):
            if not len(live):
                break
            lo[live], hi[live] = self.extend(stream[ends[live] - n], lo[live], hi[live])
            live = live[hi[live] - lo[live] > 1]
            length[live] = n + 1
        return length, lo


def suffix_order(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in order, where each 0 is smaller than later ones; passages have at most `longest` words."""
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    rank = symbols + len(ends)
    rank[ends] = np.arange(len(ends))
    h = 1
    while True:
        key = rank * np.int64(n + len(ends) + 2)
        key[:-h] += rank[h:] + 1
        order = np.argsort(key)
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        if h > longest or new[order[-1]] == n - 1:
            return order
        rank, h = new, h * 2
