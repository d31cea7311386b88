"""Live versions of the session queries.

Session facts fold forever and in order of arrival, as in batch: no watermark, nothing is late. Keyed
state grows with the number of sessions, tools and open questions, not with events.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.operators.analytics import tool_results, tool_uses
from sessionmill.operators.sessions import SNAPSHOT_EVENTS, fact_aggregates, last_events
from sessionmill.sources.logs import read_events
from sessionmill.sources.tail import tail_events


def live_facts(events: DataFrame) -> DataFrame:
    """Session facts; use output mode update or complete. Tool counts are a stream of their own and join at query time."""
    return events.groupBy("session_id").agg(*fact_aggregates(F.col("seq")))


def live_tool_counts(events: DataFrame) -> DataFrame:
    names = F.concat("tool_uses", F.when(F.col("top_tool_name").isNotNull(), F.array("top_tool_name")).otherwise(F.array().cast("array<string>")))
    return events.select("session_id", F.explode(names).alias("tool")).groupBy("session_id", "tool").agg(F.count(F.lit(1)).alias("n"))


def live_rate(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Events by minute of arrival."""
    return events.withWatermark("observed_at", watermark).groupBy(F.window("observed_at", "1 minute")).agg(F.count(F.lit(1)).alias("n"))


def live_matched_tool_calls(events: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Each embedded tool use with the first result that arrives at most `within` before or after it, or with none once that time is over (append mode).

    Rows are session_id, use_path, use_line, tool_use_id, tool, result_path and result_line. State holds uses and results of about the last
    two such times.
    """
    events = events.withWatermark("observed_at", within)  # of all events, so that time goes on where there are no tools
    uses, results = tool_uses(events), tool_results(events)
    uses = uses.select("session_id", "tool_use_id", "tool", F.col("seq.source_path").alias("use_path"), F.col("seq.line_index").alias("use_line"), F.col("observed_at").alias("used_at"))
    results = results.dropDuplicatesWithinWatermark(["session_id", "tool_use_id"])
    results = results.select(
        F.col("session_id").alias("of_session"), F.col("tool_use_id").alias("of_use"), F.col("seq.source_path").alias("result_path"), F.col("seq.line_index").alias("result_line"),
        F.col("observed_at").alias("answered_at"),
    )
    near = f"answered_at >= used_at - interval {within} and answered_at <= used_at + interval {within}"
    both = uses.join(results, F.expr(f"session_id = of_session and tool_use_id = of_use and {near}"), "left_outer")
    return both.select("session_id", "use_path", "use_line", "tool_use_id", "tool", "result_path", "result_line")


def publish(events: DataFrame, subscribers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str):
    """Start one query that hands each batch to every subscriber; none of them can miss events. A batch may come again after a failure, with the same number."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for f in subscribers.values():
                f(batch, number)
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def _placed(rows: DataFrame) -> DataFrame:
    """With where an event stands, named alike by the batch and the tail source."""
    return rows.withColumns({"at_path": F.regexp_replace("source_path", "^file:(//)?(?=/)", ""), "at_line": F.col("line_index")})


def follow(spark: SparkSession, root: str, deliver: Callable[[DataFrame], None], checkpoint: str, n: int = SNAPSHOT_EVENTS):
    """The last `n` events of a log tree, then all that arrive later, each once; returns the running query.

    The stream takes its place before the snapshot is read, so nothing falls between them; what both
    hold is taken out of the stream. `deliver` gets the snapshot first and then each batch; after a
    failure a batch may come again.
    """
    one_at_a_time, seen = threading.Lock(), []

    def snapshot() -> None:
        with one_at_a_time:
            if not seen:
                held = last_events(read_events(spark, root, index="nonempty"), n).persist()
                deliver(held)
                seen.append(_placed(held).select("at_path", "at_line"))  # at most n rows

    def each(batch: DataFrame, number: int) -> None:
        snapshot()
        deliver(_placed(batch).join(F.broadcast(seen[0]), ["at_path", "at_line"], "left_anti").drop("at_path", "at_line"))

    query = tail_events(spark, root, "latest", ledger=f"{checkpoint}/ledger" if checkpoint.startswith("/") else None).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
    query.processAllAvailable()  # from here on, the stream knows where it began
    snapshot()
    return query


def to_table(events: DataFrame, path: str, checkpoint: str):
    """Append events to a Parquet table, exactly once; entries are kept as JSON text."""
    rows = events.withColumn("entry", F.to_json("entry"))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def subscribe(spark: SparkSession, path: str, deliver: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 1000):
    """Start a reader of a table that to_table() fills. Each has a place of its own in it, kept in its checkpoint: it can be stopped and
    goes on from there, start over with a new checkpoint, or lag without holding up another. After a failure a batch may come again
    with the same number. Entries are JSON text."""
    shape = spark.read.parquet(path).schema
    rows = spark.readStream.schema(shape).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).start()
