"""Connected components of a large list of links, as DataFrame joins.

Links go from the larger to the smaller node. Two steps alternate: every node hands its larger
neighbours to the least of its neighbourhood (large star), then its smaller neighbours and itself to
the least of them (small star). Long chains, in whatever order they are named, fold in a number of
rounds that grows with the logarithm of their length; the rounds end when each component is one star
around its least node. Each step is cut by a checkpoint in the shared folder, so that a lost executor
costs one step at most, and hubs with very many links never meet them under one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.common import checkpointed, spread_join


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return node and root (the least node it can reach), for each node that has a link to another.

    Links may repeat and point either way; a link with a null end or to itself is ignored. No links
    give an empty result.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("whole"))
    edges = checkpointed(edges.where("whole and u > v").select("u", "v").distinct())
    state = _state(edges)
    while state[0]:
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e"))
        hub = ends.groupBy(F.col("e.x").alias("v")).agg(F.least(F.col("v"), F.min("e.y")).alias("m"))
        edges = checkpointed(spread_join(edges, hub, "v", n_rows=state[0]).select("u", F.col("m").alias("v")))
        least = edges.groupBy("u").agg(F.min("v").alias("p"))
        both = F.array(F.struct("u", F.col("p").alias("v")), F.struct(F.col("v").alias("u"), F.col("p").alias("v")))
        edges = checkpointed(spread_join(edges, least, "u", n_rows=state[0]).select(F.explode(both).alias("e")).select("e.u", "e.v").where("u > v").distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
