"""Session facts as a keyed table on disk that a stream keeps up to date, and live leaderboards from it.

Each batch adds what it knows of its sessions as mergeable partial facts, in a folder named by its number, so a batch that comes again
after a failure replaces itself. Every few batches the partial facts are merged into a new base; a base is named by the last batch in it
and counts once it is whole, and what it replaces stays until the next one, for readers that are still at work. Reading is one small
aggregation over the base and the batches after it: its cost goes by the number of sessions, not of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.functions.events import enriched
from sessionmill.operators.sessions import FACT_COLUMNS, fact_aggregates, session_facts
from sessionmill.sources.logs import LINES

#: Batches between two merges.
MERGE_EVERY = 20
#: Facts that are the value of the first or of the last event that has one.
FIRST, LAST = {"first_seen": "observed_at", "cwd": "cwd"}, {"last_seen": "observed_at", "last_entry_timestamp": "timestamp", "git_branch": "git_branch", "version": "version", "model": "model", "title": "ai_title"}
SUMS = tuple(c for c in FACT_COLUMNS if c not in ("session_id", *FIRST, *LAST))


def partial_facts(events: DataFrame) -> DataFrame:
    """What some events tell of their sessions: first and last values with their place, and sums."""
    placed = lambda c: F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("value")))
    sums = [a for c, a in zip(FACT_COLUMNS[1:], fact_aggregates(F.col("seq")), strict=True) if c in SUMS]
    firsts = [F.min(placed(c)).alias(k) for k, c in FIRST.items()]
    return events.groupBy("session_id").agg(*firsts, *(F.max(placed(c)).alias(k) for k, c in LAST.items()), *sums)


def merged(parts: DataFrame) -> DataFrame:
    """Partial facts of the same sessions as one."""
    return parts.groupBy("session_id").agg(*(F.min(k).alias(k) for k in FIRST), *(F.max(k).alias(k) for k in LAST), *(F.sum(k).alias(k) for k in SUMS))


def finished(parts: DataFrame) -> DataFrame:
    """The facts that merged partial facts stand for, as session_facts() gives them."""
    return parts.select(*(F.col(f"{c}.value").alias(c) if c in FIRST or c in LAST else F.col(c) for c in FACT_COLUMNS))


class FactTable:
    """A folder of partial facts. One stream may write to it, and any number of sessions read it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._at = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{path}/{name}" if name else path)
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _whole(self, prefix: str) -> list[int]:
        """Numbers of the finished folders of a kind, in order."""
        if not self._fs.exists(self._at()):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at())]
        numbers = sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))
        return [n for n in numbers if self._fs.exists(self._at(f"{prefix}{n:012d}/_SUCCESS"))]

    def _parts(self, upto: int | None = None) -> DataFrame | None:
        bases = [n for n in self._whole("base-") if upto is None or n <= upto]
        base = bases[-1] if bases else -1
        names = [f"base-{base:012d}"] if bases else []
        names += [f"batch-{n:012d}" for n in self._whole("batch-") if n > base and (upto is None or n <= upto)]
        return merged(self.spark.read.parquet(*(f"{self.path}/{n}" for n in names))) if names else None

    def add(self, batch: DataFrame, number: int) -> None:
        """The events of a batch; for foreachBatch."""
        partial_facts(batch).write.mode("overwrite").parquet(f"{self.path}/batch-{number:012d}")
        if number % MERGE_EVERY == MERGE_EVERY - 1:
            self.merge(number)

    def merge(self, number: int) -> None:
        """Make a base of all batches up to this one, and drop what the base before it has replaced."""
        before = self._whole("base-")
        if number in before:
            return
        self._parts(number).write.mode("overwrite").parquet(f"{self.path}/base-{number:012d}")
        if before:
            for kind in ("base-", "batch-"):
                for n in self._whole(kind):
                    if n < before[-1] or (kind == "batch-" and n == before[-1]):
                        self._fs.delete(self._at(f"{kind}{n:012d}"), True)

    def facts(self) -> DataFrame:
        """Session facts as they are now, for every batch query: totals, leaderboards, session lists."""
        parts = self._parts()
        return session_facts(enriched(self.spark.createDataFrame([], LINES))) if parts is None else finished(parts)


def keep_facts(events: DataFrame, path: str, checkpoint: str):
    """Start a query that keeps a fact table up to date with a stream of events; returns it."""
    table = FactTable(events.sparkSession, path)
    return events.writeStream.foreachBatch(table.add).option("checkpointLocation", checkpoint).start()
