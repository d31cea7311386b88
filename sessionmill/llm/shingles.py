"""Sets of five-word shingles, and the keys under which similar sets are sure to meet.

Shingles have one order: common ones last, the others by hash. Of two sets of a similarity of s or more,
each holds at most n - ceil(s n) shingles that the other lacks, so the first shingle that they share is
among the first n - ceil(s n) + 1 of either.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.arrays import scramble, texts

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Documents on which common shingles are counted, about; a shingle of COMMON of them goes last. Only the order depends on it, never the result.
SAMPLE, COMMON, MAX_COMMON = 20_000, 5, 100_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def as_fraction(similarity: float) -> Fraction:
    return Fraction(similarity).limit_denominator(1000)


def shingle_sets(column: pa.Array, shingle_words: int = SHINGLE_WORDS):
    """The distinct shingles of each text as sorted 64-bit hashes; a text of fewer words is one shingle, of no words none."""
    for t in texts(column, lower=True):
        h, cuts, k = t.hashes, t.word_offsets.tolist(), shingle_words
        m = max(len(h) - k + 1, 0)
        with np.errstate(over="ignore"):
            rolled = np.zeros(m, np.uint64)
            for i in range(k):
                rolled = rolled * _STEP + h[i : i + m]
            rolled = scramble(rolled)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo >= k:
                    yield np.unique(rolled[lo : hi - k + 1])
                else:
                    yield np.array([xxhash.xxh64_intdigest(h[lo:hi].tobytes(), 1)] if hi > lo else [], np.uint64)


def is_common(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each shingle whether it is in the sorted array `common`."""
    if not len(common):
        return np.zeros(len(shingles), bool)
    return common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles


def head(shingles: np.ndarray, common: np.ndarray, similarity: Fraction) -> np.ndarray:
    """The shingles of a set among which the first is that it shares with any similar set."""
    n = len(shingles)
    last = is_common(shingles, common)
    least = -(-similarity.numerator * n // similarity.denominator)
    return np.concatenate([shingles[~last], shingles[last]])[: n - least + 1] if n else shingles


def common_shingles(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Shingles of many texts by a sample of them, the most common first to be taken; sorted. Reads the column text."""

    def run(batches):
        for batch in batches:
            for s in shingle_sets(batch.column(0), shingle_words):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["s"])

    every = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").mapInArrow(run, "s long")
    counts = some.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= COMMON)
    rows = counts.orderBy(F.desc("c"), "s").limit(MAX_COMMON).select("s").toArrow()  # bounded
    return np.sort(rows.column(0).to_numpy().view(np.uint64))
