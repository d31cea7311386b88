"""Texts of an Arrow batch as flat byte arrays, with their words found in one pass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once (a longer document stands alone).
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MIX = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    name = str(base)
    if name not in _powers or len(_powers[name]) < n:
        x = np.full(max(n, CHUNK), base, np.uint64)
        x[0] = 1
        with np.errstate(over="ignore"):
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers[name][:n]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Texts:
    """Documents lo..hi-1 of a batch: document i has the bytes data[offsets[i]:offsets[i+1]]."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @cached_property
    def _cuts(self) -> tuple[np.ndarray, np.ndarray]:
        word = ~_SPACE[self.data]
        n = len(word)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        start = word.copy()
        start[1:] &= ~word[:-1] | edge[1:n]
        end = word.copy()
        end[:-1] &= ~word[1:] | edge[1:n]
        return np.flatnonzero(start), np.flatnonzero(end) + 1

    @property
    def starts(self) -> np.ndarray:
        """First byte of each word."""
        return self._cuts[0]

    @property
    def ends(self) -> np.ndarray:
        return self._cuts[1]

    @cached_property
    def word_offsets(self) -> np.ndarray:
        """Document i has the words word_offsets[i] .. word_offsets[i+1] - 1."""
        return np.searchsorted(self.starts, self.offsets)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_offsets)

    @cached_property
    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.n_words)

    @cached_property
    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        if not n:
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_MIX[self.data] * _power(_ODD, n), out=sums[1:], dtype=np.uint64)
            own = (sums[self.ends] - sums[self.starts]) * _power(_INVERSE, n)[self.starts]
            return scramble(own + (self.ends - self.starts).astype(np.uint64))

    def per_doc(self, per_byte: np.ndarray) -> np.ndarray:
        """Sums of a number for each byte, by document."""
        sums = np.zeros(len(per_byte) + 1, np.float64 if per_byte.dtype.kind == "f" else np.int64)
        np.cumsum(per_byte, out=sums[1:])
        return np.diff(sums[self.offsets])

    def per_doc_words(self, per_word: np.ndarray) -> np.ndarray:
        """Sums of a number for each word, by document."""
        sums = np.zeros((len(per_word) + 1, *per_word.shape[1:]), np.float64 if per_word.dtype.kind == "f" else np.int64)
        np.cumsum(per_word, axis=0, out=sums[1:])
        return np.diff(sums[self.word_offsets], axis=0)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def texts(column: pa.Array, lower: bool = False, limit: int = CHUNK) -> Iterator[Texts]:
    """The texts of an Arrow column in chunks of whole documents; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        own = data[offsets[lo] : offsets[hi]]
        yield Texts(lo, hi, LOWER[own] if lower else own, offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that Texts.hashes gives these words."""
    if not words:
        return np.empty(0, np.uint64)
    out = [t.hashes for t in texts(pa.array([w.encode() for w in words], pa.binary()))]
    return np.concatenate(out)
