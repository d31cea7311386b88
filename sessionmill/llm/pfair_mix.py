"""Mixing sources to target weights by Pfair scheduling.

The fluid target serves all sources at once, each at a rate in proportion to its weight, until it has
given its last block; x(t) is what a source has been given when t blocks went in all. Its i-th block may
run from the slot in which x passes i and must have run by the slot in which x reaches i + 1. Earliest
deadline first over these windows keeps every source within less than one block of its target at every
slot, as the windows between any two times ask for no more slots than there are. Weights count as the
exact numbers they are, and windows are computed in whole numbers, so nothing is rounded to a period.

The schedule is made from the block counts alone. There are at most about MAX_SLOTS blocks: a block is
made of more rows where the table has more. Rows are numbered within their source by hash order with
two small counting shuffles and find their block's slot in the schedule; neither the rows nor their ids
meet in one place.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.llm.common import free_names, named, table

#: Rows of a block, at least, and blocks in all, about: one for each source may come on top.
BLOCK_ROWS, MAX_SLOTS = 8, 1 << 20
#: Slots of one source that stand in one row of the schedule.
STRETCH = 1024
#: Rows of the schedule that are sent to all executors, at most; a larger one meets the rows by a shuffle.
MAX_BROADCAST = 1 << 17


def whole_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the same proportions."""
    exact = {k: Fraction(w) for k, w in weights.items()}
    if bad := sorted(k for k, w in exact.items() if w <= 0):
        raise ValueError(f"weights must be positive: {bad}")
    scale = math.lcm(*(w.denominator for w in exact.values())) if exact else 1
    return {k: int(w * scale) for k, w in exact.items()}


class FluidClock:
    """When the fluid target has given a source so many blocks: served(k, n) slots are over, as a fraction.

    Sources that run dry at the same time count as one step, and a step is found by halving.
    """

    def __init__(self, blocks: Mapping[str, int], weights: Mapping[str, int]):
        self.weights = weights
        steps: dict[Fraction, list[int]] = {}
        for k, n in blocks.items():
            step = steps.setdefault(Fraction(n, weights[k]), [0, 0])
            step[0] += n
            step[1] += weights[k]
        self.dry = sorted(steps)
        self.about = [float(x) for x in self.dry]
        self.given, self.rate = [0], [sum(weights[k] for k in blocks)]
        for x in self.dry:
            self.given.append(self.given[-1] + steps[x][0])
            self.rate.append(self.rate[-1] - steps[x][1])

    def served(self, source: str, n: int) -> tuple[int, int]:
        """Numerator and denominator."""
        w = self.weights[source]
        low, high = bisect_left(self.about, n / w * (1 - 1e-9)), bisect_right(self.about, n / w * (1 + 1e-9))
        while low < high:
            mid = (low + high) // 2
            if self.dry[mid].numerator * w <= n * self.dry[mid].denominator:
                low = mid + 1
            else:
                high = mid
        return self.given[low] * w + self.rate[low] * n, w


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float]) -> dict[str, np.ndarray]:
    """The slots of each source's blocks, in their order; the slots 0, 1, .. are each used once."""
    clock = FluidClock(blocks, whole_weights({k: weights[k] for k in blocks}))
    slots = {k: np.empty(n, np.int64) for k, n in blocks.items()}
    done = dict.fromkeys(blocks, 0)
    waiting = [(0, k) for k in sorted(k for k, n in blocks.items() if n)]  # release, source
    ready: list[tuple[int, str]] = []  # deadline, source
    for slot in range(sum(blocks.values())):
        while waiting and waiting[0][0] <= slot:
            _, k = heapq.heappop(waiting)
            over, per = clock.served(k, done[k] + 1)
            heapq.heappush(ready, (-(-over // per), k))
        _, k = heapq.heappop(ready)
        slots[k][done[k]] = slot
        done[k] += 1
        if done[k] < blocks[k]:
            over, per = clock.served(k, done[k])
            heapq.heappush(waiting, (over // per, k))
    return slots


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def tempered(temperature: float = 0.5) -> Callable[[Mapping[str, int]], dict[str, float]]:
    """Weights in proportion to a power of the sizes."""
    return lambda sizes: {k: n**temperature for k, n in sizes.items()}


def pfair_mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | Callable[[Mapping[str, int]], Mapping[str, float]] | None = None,
    block_rows: int | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """The input rows with __block (of its source), __slot and __place (in the whole mix) added.

    `weights`: by source (a source it lacks, or null, needs an entry of its own), or a function of
    the row counts; by default in proportion to their square roots. They must be above 0, and hold as
    long as a source has rows left; the others then share its part by theirs. There can be any number
    of sources, but the driver holds a count and a weight of each. `block_rows`: by default
    BLOCK_ROWS, or as many as make about MAX_SLOTS blocks. Rows of a source are taken in the order of
    a hash of their ids and of their places in the input, so that rows that share an id spread too; the
    input must read alike each time, as a table or a checkpoint does. Null is a source of its own.
    Columns named as the three added ones are replaced; others may have any names. An empty table gives
    an empty result.
    """
    keep = [named(c) for c in docs.columns if c.lower() not in ("__block", "__slot", "__place")]
    source, mark, high, low, row, index = free_names(docs, "source_key", "row_hash", "high_bits", "low_bits", "row_in_bucket", "row_index")
    rows_in = docs.select(*keep, _source_key(named(source_col)).alias(source), F.xxhash64(named(id_col).cast("string"), F.monotonically_increasing_id()).alias(mark))
    sizes = {r[0]: r[1] for r in rows_in.groupBy(source).agg(F.count(F.lit(1))).collect()}
    weights = tempered() if weights is None else weights
    if callable(weights):
        weights = weights(sizes)
    else:
        weights = {"" if k is None else f"={k}": w for k, w in weights.items()}
        if missing := sorted(set(sizes) - set(weights)):
            raise ValueError(f"no weight for sources {missing}")
    rows = sum(sizes.values())
    block_rows = block_rows or max(BLOCK_ROWS, -(-rows // MAX_SLOTS))
    slots = schedule({k: -(-n // block_rows) for k, n in sizes.items()}, weights)

    # Number the rows of each source: hash buckets of some hundred rows, their sizes added up in two levels.
    side = max(1, math.isqrt(max(1, rows // 256)))
    hashed = rows_in.withColumn(high, F.pmod(F.xxhash64(mark), F.lit(side)).cast("int"))
    hashed = hashed.withColumn(low, F.pmod(F.floor(F.xxhash64(mark) / side), F.lit(side)).cast("int"))
    counts = hashed.groupBy(source, high, low).agg(F.count(F.lit(1)).alias("n"))
    before = lambda *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    highs = counts.groupBy(source, high).agg(F.sum("n").alias("n")).select(source, high, before(source, high).alias("before_high"))
    lows = counts.select(source, high, low, before(source, high, low).alias("before_low"))
    offsets = lows.join(highs, [source, high]).select(source, high, low, (F.col("before_high") + F.col("before_low")).alias(index))
    bucket = Window.partitionBy(source, high, low).orderBy(mark)
    numbered = hashed.withColumn(row, F.row_number().over(bucket)).join(offsets, [source, high, low])
    numbered = numbered.withColumn(index, F.col(index) + F.col(row) - 1).withColumn("__block", F.floor(F.col(index) / block_rows))

    # Each block finds its slot in the schedule, which is cut into short stretches.
    stretch, at = free_names(docs, "stretch", "slots_of_stretch")
    parts = [(k, i // STRETCH, own[i : i + STRETCH]) for k, own in slots.items() for i in range(0, len(own), STRETCH)]
    cuts = np.cumsum([0, *(len(x) for *_, x in parts)])
    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *(x for *_, x in parts)])))
    columns = [pa.array([k for k, *_ in parts], pa.string()), pa.array([i for _, i, _ in parts], pa.int64()), lists]
    table = docs.sparkSession.createDataFrame(pa.table(columns, [source, stretch, at]))
    table = F.broadcast(table) if len(parts) <= MAX_BROADCAST else table
    placed = numbered.withColumn(stretch, F.floor(F.col("__block") / STRETCH)).join(table, [source, stretch])
    placed = placed.withColumn("__slot", F.get(at, F.pmod("__block", F.lit(STRETCH)).cast("int")))
    place = F.col("__slot") * block_rows + F.pmod(F.col(index), F.lit(block_rows))
    return placed.select(*keep, "__block", "__slot", place.cast("long").alias("__place"))


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, all of them and with the same columns, sorted into the mix."""
    own = docs.columns
    aside = {c: free_names(docs, f"own_{c}")[0] for c in own if c.lower() in ("__block", "__slot", "__place")}
    mixed = pfair_mix(docs.withColumnsRenamed(aside), **options).orderBy("__place")
    return mixed.select(*(named(aside.get(c, c)).alias(c) for c in own))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair_mix(docs).select("doc_id", "source", F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__place").alias("place"))
