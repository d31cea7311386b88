"""Session facts and the recent-event views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Events kept per session and over all, and the size of a snapshot.
SESSION_RING = 5_000
GLOBAL_RING = 20_000
SNAPSHOT_EVENTS = 500
#: Lines of a file that one task takes of a session.
BLOCK_LINES = 1 << 16

FACT_COLUMNS = (
    "session_id", "first_seen", "last_seen", "last_entry_timestamp", "cwd", "git_branch", "version", "model", "title", "event_count", "user_count",
    "assistant_count", "system_count", "tool_use_count", "tool_result_count", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cost_usd",
)


def fact_aggregates(order: Column) -> list[Column]:
    """The measures of a session; `order` is the order of arrival. Also good for streaming aggregation."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order))
    of_type = lambda *names: F.count_if(F.col("event_type").isin(*names))
    tokens = lambda c: F.coalesce(F.sum(f"usage.{c}"), F.lit(0)).cast("long")
    return [
        F.min_by("observed_at", order).alias("first_seen"),
        F.max_by("observed_at", order).alias("last_seen"),
        last("timestamp").alias("last_entry_timestamp"),
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), order)).alias("cwd"),
        last("git_branch").alias("git_branch"),
        last("version").alias("version"),
        last("model").alias("model"),
        last("ai_title").alias("title"),
        F.count(F.lit(1)).alias("event_count"),
        of_type("user").alias("user_count"),
        of_type("assistant").alias("assistant_count"),
        of_type("system").alias("system_count"),
        (of_type("tool_use") + F.sum(F.size("tool_uses"))).alias("tool_use_count"),
        (of_type("tool_result") + F.sum(F.size("tool_results"))).alias("tool_result_count"),
        tokens("input").alias("input_tokens"),
        tokens("output").alias("output_tokens"),
        tokens("cache_read").alias("cache_read_tokens"),
        tokens("cache_creation").alias("cache_creation_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
    ]


def session_facts(events: DataFrame) -> DataFrame:
    """One row per session without the map of tool counts: one aggregation, one exchange."""
    return events.groupBy("session_id").agg(*fact_aggregates(F.col("seq")))


def tool_counts(events: DataFrame) -> DataFrame:
    """session_id, tool, n: embedded tool uses and top-level ones."""
    names = F.concat("tool_uses", F.when(F.col("top_tool_name").isNotNull(), F.array("top_tool_name")).otherwise(F.array().cast("array<string>")))
    used = events.select("session_id", F.explode(names).alias("tool"))
    return used.groupBy("session_id", "tool").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame) -> DataFrame:
    """Session facts with tool_counts, a map of tool to count; most recent first when sorted by order_sessions()."""
    by_session = tool_counts(events).groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("tool_counts"))
    none = F.create_map().cast("map<string,bigint>")
    return session_facts(events).join(by_session, "session_id", "left").withColumn("tool_counts", F.coalesce("tool_counts", none))


def order_sessions(facts: DataFrame) -> DataFrame:
    return facts.orderBy(F.desc("last_seen"), "session_id")


def block_of(line_index: Column, block_lines: int = BLOCK_LINES) -> Column:
    """Which stretch of a file's lines a line is in; a session of any size is many of them."""
    return F.floor(line_index / block_lines)


def recent_per_session(events: DataFrame, n: int | None = SESSION_RING, block_lines: int = BLOCK_LINES) -> DataFrame:
    """The last n events of each session; None keeps all.

    Each block of lines numbers its own from the last, and counts of the blocks tell how many events come after each, so blocks that are too
    old fall away as a whole: no session is sorted in one task. There can be nearly as many blocks as events where sessions are short, which
    Spark does not foresee, so the two meet by a shuffle and never by a broadcast through the driver. A limit on the number alone would have
    Spark sort all that a task reads before the shuffle, which takes memory by the size of the task's part of the table; the number is held
    against n only together with the count. Within a block the line number is the order, so the sort carries no `seq` that nobody asks for.
    """
    if n is None:
        return events
    block = ["session_id", "__path", "__block"]
    rows = events.withColumns({"__path": F.col("seq.source_path"), "__block": block_of(F.col("seq.line_index"), block_lines)})
    later = Window.partitionBy("session_id").orderBy(F.desc("__path"), F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("__n"))
    kept = counts.select(*block, F.coalesce(F.sum("__n").over(later), F.lit(0)).alias("__after")).where(F.col("__after") < n)
    newest = Window.partitionBy(*block).orderBy(F.desc("line_index"))
    rows = rows.withColumn("__nth", F.row_number().over(newest))
    rows = rows.join(kept.hint("merge"), block).where(F.col("__nth") + F.col("__after") <= n)
    return rows.select(*events.columns)


def with_costs_in_order(facts: DataFrame, events: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Session facts whose cost_usd is added up in order of arrival, as a reader of the log adds it; shown to four places, another order can show another last digit.

    A session of more than `block_lines` events is added up by blocks of lines, and the blocks' sums in order: it never meets in one task.
    """
    place = [F.col("seq.source_path").alias("path"), block_of(F.col("seq.line_index"), block_lines).alias("block")]
    blocks = events.groupBy("session_id", *place).agg(F.array_sort(F.collect_list(F.struct("seq.line_index", "cost_usd"))).alias("lines"))
    sizes = blocks.groupBy("session_id").agg(F.sum(F.size("lines")).alias("n"))
    at = F.struct("path", "block")
    stretches = blocks.join(sizes.hint("merge"), "session_id").groupBy("session_id", F.when(F.col("n") > block_lines, at).alias("stretch"))
    added = lambda items: F.aggregate(items, F.lit(0.0), lambda total, x: total + x["cost_usd"])
    lines = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), "lines"))), lambda b: b["lines"]))
    sums = stretches.agg(added(lines).alias("cost_usd"))
    costs = sums.groupBy("session_id").agg(added(F.array_sort(F.collect_list(F.struct("stretch", "cost_usd")))).alias("__cost"))
    joined = facts.join(costs.hint("merge"), "session_id", "left").withColumn("cost_usd", F.coalesce("__cost", "cost_usd"))
    return joined.select(*facts.columns)


def last_events(events: DataFrame, n: int = GLOBAL_RING) -> DataFrame:
    """The last n events to arrive, in ascending order."""
    newest = events.orderBy(F.desc("observed_at"), F.desc("seq")).limit(n)
    return newest.orderBy("observed_at", "seq")


def session_events(events: DataFrame, session_id: str, limit: int | None = None, ring: int | None = SESSION_RING) -> DataFrame:
    """One session's events in order, or its last `limit`; none for an unknown session."""
    own = events.where(F.col("session_id") == session_id)
    keep = [x for x in (limit, ring) if x is not None]
    if keep:
        own = own.orderBy(F.desc("seq")).limit(min(keep))
    return own.orderBy("seq")


def with_min_events(facts: DataFrame, n: int = 1) -> DataFrame:
    return facts.where(F.col("event_count") >= n)


def select_sessions(facts: DataFrame, ids: list[str] | None) -> DataFrame:
    """Only these sessions. None keeps all; an empty list keeps none."""
    return facts if ids is None else facts.where(F.col("session_id").isin(ids)) if ids else facts.where(F.lit(False))


def parse_session_list(value: str | None) -> list[str] | None:
    """From 'a, b,,' to ['a', 'b']; None stays None."""
    return None if value is None else [x.strip() for x in value.split(",") if x.strip()]


def deduplicated(events: DataFrame, key: str = "file") -> DataFrame:
    """Events once each, by file and line, or with key="session" by session and line: the first to arrive."""
    keys = {"file": ["source_path", "line_index"], "session": ["session_id", "line_index"]}
    if key not in keys:
        raise ValueError(f"unknown key {key!r}")
    first = Window.partitionBy(*keys[key]).orderBy("observed_at", "seq")
    return events.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")
