"""Variable-capacity best-fit packing of documents into training sequences.

Documents longer than the largest sequence are cut into pieces of that length; nothing is dropped. A
piece of just that length fills a bin alone and needs no packing. The others, one of each document at
most, go to lanes of bounded size, and each lane is packed by itself in decreasing length: a piece goes
to the open bin with the least room that holds it; where there is none, every permitted length is tried,
filled on paper with the longest remaining pieces that fit, and the length of least cost per word opens.
At the end each bin shrinks to the smallest permitted length that holds its content.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.common import n_words, named, table

CAPACITIES = (256, 512, 1024, 2048, 4096, 8192)


def sequence_cost(capacity: int) -> float:
    """A sequence costs a fixed part, its length, and attention in the square of its length."""
    return 16 + capacity + capacity * capacity / 16384


class Remaining:
    """The lengths still to be placed, with the next one at or below a limit in near-constant time."""

    def __init__(self, lengths: list[int]):
        self.values = sorted(set(lengths))
        self.count = dict.fromkeys(self.values, 0)
        for n in lengths:
            self.count[n] += 1
        self.below = list(range(-1, len(self.values) - 1))
        self.gone = [False] * len(self.values)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.gone[bisect_left(self.values, n)] = True

    def at_most(self, i: int) -> int:
        """The index of the longest remaining length at or before index i, or -1."""
        path = []
        while i >= 0 and self.gone[i]:
            path.append(i)
            i = self.below[i]
        for j in path:
            self.below[j] = i
        return i

    def fill(self, room: int) -> int:
        """Words that a bin with this room would take, longest first."""
        left = room
        i = self.at_most(bisect_right(self.values, left) - 1)
        while left > 0 and i >= 0 and self.values[i] > 0:
            n = self.values[i]
            left -= n * min(self.count[n], left // n)
            i = self.at_most(min(i - 1, bisect_right(self.values, left) - 1))
        return room - left


def pack(lengths: list[int], capacities=CAPACITIES, cost=sequence_cost) -> list[tuple[int, int]]:
    """For each length its bin and the bin's final capacity. Lengths are at most the largest capacity."""
    capacities = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    rest = Remaining(lengths)
    rooms: list[tuple[int, int]] = []  # room left, bin; sorted
    filled: list[int] = []
    bins = [0] * len(lengths)
    for i in order:
        n = lengths[i]
        rest.take(n)
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            fits = [c for c in capacities if c >= n]
            room = min(fits, key=lambda c: (cost(c) / max(1, n + rest.fill(c - n)), c))
            b = len(filled)
            filled.append(0)
        bins[i] = b
        filled[b] += n
        insort(rooms, (room - n, b))
    final = [capacities[bisect_left(capacities, x)] for x in filled]
    return [(b, final[b]) for b in bins]


def best_fit_packing(
    docs: DataFrame,
    capacities=CAPACITIES,
    length: Column | None = None,
    lane: Column | None = None,
    lane_rows: int = 16384,
    id_col: str = "doc_id",
    text_col: str = "text",
    cost=sequence_cost,
) -> DataFrame:
    """Return one row per piece: doc_id, piece, start, length, lane, bin, capacity, place.

    `length`: an expression for the length of a document, by default its words; null counts as 0.
    A piece covers length words from word `start` on; `bin` is unique within its lane, and pieces
    stand in a bin in the order of `place`. Empty documents are pieces of length 0 and cost no
    room. A piece that fills the largest bin has one to itself, with a number below 0. `lane`: an
    expression for the lane, which the caller keeps to some `lane_rows` documents; by default a hash of
    each row's id and place over as many lanes as give each about that many, however many rows share
    an id. Rows that share an id are packed each on its own; other columns are ignored; an empty table
    gives an empty result.
    """
    largest = max(capacities)
    size = F.coalesce((n_words(named(text_col)) if length is None else length).cast("long"), F.lit(0).cast("long"))
    if lane is None:
        lanes = max(1, -(-docs.count() // lane_rows))
        lane = F.pmod(F.xxhash64(named(id_col), F.monotonically_increasing_id()), F.lit(lanes))
    sized = docs.select(named(id_col).alias("doc_id"), size.alias("size"), lane.cast("long").alias("lane"))
    whole = F.floor(F.col("size") / largest)
    sized = sized.select("doc_id", "lane", whole.alias("whole"), (F.col("size") - whole * largest).alias("rest"))
    id_type = dict(sized.dtypes)["doc_id"]

    def pack_lane(rows: pa.Table) -> pa.Table:
        # Ids stay as they are: only lengths become numbers of numpy.
        rows = rows.sort_by([("rest", "descending"), ("whole", "ascending"), ("doc_id", "ascending")])
        rest, whole = rows["rest"].to_numpy(), rows["whole"].to_numpy()
        alone = (rest == 0) & (whole > 0)
        order = np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])
        n, rest, whole = int((~alone).sum()), rest[order], whole[order]
        bins, capacity, place = np.full(len(order), -1), np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        if n:
            bins[:n], capacity[:n] = np.array(pack(rest[:n].tolist(), capacities, cost), np.int64).T
            by_bin = np.argsort(bins[:n], kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(bins[by_bin]) != 0])
            place[by_bin] = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
        columns = [rest, bins, capacity, place, np.cumsum(whole) - whole]
        rows = rows.take(pa.array(order))
        return pa.table([rows["doc_id"], rows["lane"], rows["whole"], *map(pa.array, columns)], ["doc_id", "lane", "whole", "rest", "bin", "capacity", "place", "before"])

    lanes = sized.groupBy("lane").applyInArrow(pack_lane, f"doc_id {id_type}, lane long, whole long, rest long, bin long, capacity long, place long, before long")
    piece = lambda nth, length, bin_, capacity, place: F.struct(nth.alias("piece"), (nth * largest).alias("start"), length.alias("length"), bin_.alias("bin"), capacity.alias("capacity"), place.alias("place"))
    last = F.filter(F.array(piece(F.col("whole"), F.col("rest"), F.col("bin"), F.col("capacity"), F.col("place"))), lambda x: x["bin"] >= 0)
    most, first = F.lit(largest).cast("long"), F.lit(0).cast("long")
    every = F.sequence(first, F.greatest(F.col("whole") - 1, first))
    full = F.when(F.col("whole") > 0, F.transform(every, lambda i: piece(i, most, -1 - F.col("before") - i, most, first))).otherwise(F.slice(last, 1, 0))
    return lanes.select("doc_id", "lane", F.explode(F.concat(full, last)).alias("p")).select("doc_id", "p.piece", "p.start", "p.length", "lane", "p.bin", "p.capacity", "p.place")


def query(spark, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
