"""Links among rows that share a key, tile by tile, with nothing left out.

The rows of a key that fit a tile are compared in one task. A key with more is dealt into tiles by
hash, each of which first links its own rows; then two rows of each group found so far meet, so that
the tiles' parts of one large group become one. Only rows outside a key's largest group can still
have unknown links; they are compared with all rows of the key, pair of tiles by pair of tiles, each
a task of its own, and a pair whose rows are too far apart by their rank is never made. So a key under
which a third of all rows are near copies costs about as much as its rows, and never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.common import checkpointed
from sessionmill.llm.components import components

#: Most keys of more than a tile that are sent to all executors; more are joined by a shuffle.
MAX_BROADCAST_KEYS = 100_000
LINKS = "a long, b long"


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def whole_groups(batches, rows: int):
    """Tables of about `rows` rows, cut between values of the first column, by which the batches are sorted."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column(0).to_numpy()
        new = np.flatnonzero(key[1:] != key[:-1])
        if len(new):
            cut = int(new[-1]) + 1
            yield table.slice(0, cut)
            table = table.slice(cut)
        held, size = table.to_batches(), table.num_rows
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _grouped(rows: DataFrame, key: str, compare) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(compare, LINKS)


def group_links(rows: DataFrame, compare, tile: int, rank: Column, reach: int) -> DataFrame:
    """Links (a, b) that connect the nodes of each key just as all links between them would.

    rows: key (a number), node, and more columns, with lineage already cut; a node can stand under
    many keys, and two rows of a key and node are alike. `compare` gets batches sorted by their first
    column, the key, and returns a spanning forest of the links within each key. Rows whose `rank`,
    a whole number, differs by more than `reach` are never linked.
    """
    sizes = checkpointed(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows_of_key")).where(F.col("rows_of_key") > tile))
    n_large = sizes.count()
    if not n_large:
        return _grouped(rows, "key", compare)
    held = F.broadcast(sizes) if n_large <= MAX_BROADCAST_KEYS else sizes
    few = _grouped(rows.join(held, "key", "left_anti"), "key", compare)
    others = [c for c in rows.columns if c != "key"]
    many = checkpointed(rows.join(held, "key").withColumn("rank", rank.cast("long")))

    def dealt(own: DataFrame, n: str, *by: str) -> DataFrame:
        cut = F.pmod(F.xxhash64("node"), F.ceil(F.col(n) / tile))
        return own.select(F.xxhash64("key", *by, cut).alias("key"), *others)

    links = checkpointed(few.unionByName(_grouped(dealt(many, "rows_of_key"), "key", compare)))
    # Two rows of each group of a key stand for it.
    draw = F.struct(F.xxhash64("node"), *others)
    named = checkpointed(_named(many, links))
    heads = named.groupBy("key", "root").agg(F.array_distinct(F.array(F.min(draw), F.max(draw))).alias("heads"))
    heads = checkpointed(heads.select("key", F.explode("heads").alias("h")).select("key", *(F.col(f"h.{c}").alias(c) for c in others)))
    counts = heads.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    links = checkpointed(links.unionByName(_grouped(dealt(heads.join(counts, "key"), "m"), "key", compare)))
    # What is outside the largest group of its key meets all of the key, in pairs of tiles.
    named = checkpointed(_named(many, links))
    groups = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    largest = groups.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("most"), F.count(F.lit(1)).alias("groups")).where("groups > 1").select("key", "most")
    left = named.join(largest, "key").withColumn("apart", F.col("root") != F.col("most"))
    cuts = left.groupBy("key", "apart", "rank").agg(F.ceil(F.count(F.lit(1)) / tile).alias("cuts"))
    tiles = checkpointed(cuts.select("key", "apart", "rank", "cuts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut")))
    x, y = tiles.alias("x"), tiles.alias("y")
    own = F.struct("x.apart", "x.rank", "x.cut")
    other = F.struct("y.apart", "y.rank", "y.cut")
    pairs = x.join(y, "key").where(F.col("x.apart") & (F.abs(F.col("x.rank") - F.col("y.rank")) <= reach) & (~F.col("y.apart") | (own <= other)))
    sides = pairs.select("key", F.xxhash64("key", own, other).alias("pair"), F.explode(F.array_distinct(F.array(own, other))).alias("s"))
    sides = sides.select("key", "pair", "s.apart", "s.rank", "s.cut")
    left = left.join(F.broadcast(cuts) if n_large <= 1_000 else cuts, ["key", "apart", "rank"]).withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")))
    met = left.join(sides, ["key", "apart", "rank", "cut"]).select(F.col("pair").alias("key"), *others)
    return links.unionByName(checkpointed(_grouped(met, "key", compare)))


def _named(many: DataFrame, links: DataFrame) -> DataFrame:
    """The rows with the root of the group that their node is in."""
    roots = components(links).withColumnRenamed("root", "found")
    return many.join(roots, "node", "left").withColumn("root", F.coalesce("found", "node")).drop("found")
