"""Totals, leaderboards, latency, histograms over time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.functions.jsonx import at, blocks, of_kind, str_at
from sessionmill.functions.text import project_name
from sessionmill.operators.sessions import BLOCK_LINES, block_of

TOP_TOOLS, TOP_SESSIONS, SPARK_BINS, TIMELINE_MINUTES = 15, 10, 24, 60


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name)


def exact_sum(name: str) -> Column:
    """The sum of a double column, each number to 15 decimal places, rounded once: the order of the rows has no part in it. Numbers too large for that are added as doubles."""
    exact = F.col(name).try_cast("decimal(38,15)")
    return F.coalesce(F.when(F.count(exact) == F.count(name), F.try_sum(exact).cast("double")), F.sum(name))


def global_totals(facts: DataFrame, session_id: str | None = None) -> DataFrame:
    """One row of sums over session facts, or over one session's."""
    own = facts if session_id is None else facts.where(F.col("session_id") == session_id)
    names = ("event_count", "user_count", "assistant_count", "tool_use_count", "tool_result_count", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    return own.agg(F.count(F.lit(1)).alias("session_count"), *(_total(n) for n in names), F.coalesce(exact_sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))


def cache_hit(totals: DataFrame) -> DataFrame:
    """Adds cache_hit_pct: the share of input tokens read from cache, to one place; 0 without input."""
    seen = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    return totals.withColumn("cache_hit_pct", F.coalesce(F.round(F.lit(100.0) * F.col("cache_read_tokens") / F.nullif(seen, F.lit(0)), 1), F.lit(0.0)))


def health(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count(F.lit(1)).alias("session_count"), _total("event_count").alias("total_events"))


def with_bar(rows: DataFrame, value: str) -> DataFrame:
    """Adds bar_pct: each value as a share of the largest, to one place. For the few rows of a leaderboard."""
    return rows.withColumn("bar_pct", F.coalesce(F.round(F.lit(100.0) * F.col(value) / F.nullif(F.max(value).over(Window.partitionBy()), F.lit(0)), 1), F.lit(0.0)))


def top_tools(counts: DataFrame, n: int = TOP_TOOLS) -> DataFrame:
    """From session_id, tool, n: the most used tools."""
    totals = counts.groupBy("tool").agg(F.sum("n").cast("long").alias("n"))
    return with_bar(totals.orderBy(F.desc("n"), "tool").limit(n), "n")


def merged_tool_counts(session_rows: DataFrame) -> DataFrame:
    """The maps of tool counts of all sessions, added up."""
    pairs = session_rows.select("session_id", F.explode("tool_counts").alias("tool", "n"))
    return pairs.groupBy("tool").agg(F.sum("n").cast("long").alias("n"))


def top_sessions(facts: DataFrame, by: str = "cost_usd", n: int = TOP_SESSIONS) -> DataFrame:
    return with_bar(facts.orderBy(F.desc(by), "session_id").limit(n), by)


def project_groups(facts: DataFrame) -> DataFrame:
    """cwd, project, session_count and the time last seen, by working directory."""
    key = F.coalesce(F.nullif("cwd", F.lit("")), F.lit("__unknown__"))
    groups = facts.groupBy(key.alias("cwd")).agg(F.count(F.lit(1)).alias("session_count"), F.max("last_seen").alias("last_seen"))
    return groups.withColumn("project", project_name(F.when(F.col("cwd") != "__unknown__", F.col("cwd"))))


def latencies(events: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Milliseconds from a user event to the first assistant event after it, other events aside.

    A session is worked on in blocks of lines, so a large one is many tasks. What a block leaves open is carried to the next by a small
    table of the first and last turn of each block.
    """
    turns = events.where(F.col("event_type").isin("user", "assistant"))
    turns = turns.select("session_id", F.col("seq.source_path").alias("path"), F.col("seq.line_index").alias("line"), "event_type", "event_ts")
    turns = turns.withColumn("block", block_of(F.col("line"), block_lines))
    block = ("session_id", "path", "block")
    order = Window.partitionBy(*block).orderBy("line")
    turns = turns.withColumns({"before": F.lag("event_type").over(order), "asked": F.lag("event_ts").over(order), "after": F.lead("event_type").over(order)})
    inside = turns.where("event_type = 'assistant' and before = 'user'").select("session_id", "path", "line", "event_ts", "asked")
    turn = F.struct("event_type", "event_ts", "line")
    ends = turns.where("before is null or after is null").groupBy(*block).agg(F.min_by(turn, "line").alias("first"), F.max_by(turn, "line").alias("last"))
    ends = ends.withColumn("open", F.lag("last").over(Window.partitionBy("session_id").orderBy("path", "block")))
    across = ends.where("first.event_type = 'assistant' and open.event_type = 'user'").select("session_id", "path", "first.line", "first.event_ts", F.col("open.event_ts").alias("asked"))
    seq = F.struct(F.col("path").alias("source_path"), F.col("line").alias("line_index"))
    both = inside.unionByName(across)
    return both.select("session_id", seq.alias("seq"), (F.unix_millis("event_ts") - F.unix_millis("asked")).alias("latency_ms")).where("latency_ms is not null")


def percentile_at(rows: DataFrame, value: str, shares: dict[str, float], bins: int = 4096) -> DataFrame:
    """One row: for each share p the value at place floor(n * p) of the sorted values (from 0), or 0 without values. Any numbers; nulls are left out.

    Nothing is sorted. Values are counted in equal bins between the least and the greatest, all shares in one job; the bin that holds a
    share's place is cut into bins again, until one value is left: a few passes, however the values are spread. The driver sees
    `bins` counts of each share.
    """
    values = rows.select(F.col(value).alias("v")).where("v is not null")
    kind = values.dtypes[0][1]
    values.persist()
    try:
        n, low, high = values.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
        places = {k: math.floor(n * p) for k, p in shares.items()}
        within = {k: (low, high, 0) for k in shares if places[k] < n}  # least, greatest, values below
        while todo := {k: x for k, x in within.items() if x[0] != x[1]}:
            asks = [F.when(F.col("v").between(F.lit(a), F.lit(b)), F.struct(F.lit(k).alias("name"), _bin(F.col("v"), a, b, bins).alias("bin"), "v")) for k, (a, b, _) in todo.items()]
            held = values.select(F.explode(F.array_compact(F.array(*asks))).alias("x")).groupBy("x.name", "x.bin")
            for r in sorted(held.agg(F.count(F.lit(1)).alias("n"), F.min("x.v").alias("low"), F.max("x.v").alias("high")).collect(), key=lambda r: (r["name"], r["bin"])):
                k = r["name"]
                if k in todo:  # its place is in this bin or a later one
                    below = within[k][2]
                    here = below + r["n"] > places[k]
                    within[k] = (r["low"], r["high"], below) if here else (*within[k][:2], below + r["n"])
                    if here:
                        todo.pop(k)
    finally:
        values.unpersist()
    return rows.sparkSession.range(1).select(*(F.lit(within[k][0] if k in within else 0).cast(kind).alias(k) for k in shares))


def _bin(v: Column, low, high, bins: int) -> Column:
    """Which of the bins between two values; the two are never in the same."""
    if isinstance(low, int) and high - low < 1 << 62:
        from_low = v.cast("long") - F.lit(low)
        width = -(-(high - low + 1) // bins)
        return ((from_low - F.pmod(from_low, F.lit(width))) / F.lit(width)).cast("long") if width > 1 else from_low
    share = (v.cast("double") - float(low)) / (float(high) - float(low))
    return F.least(F.floor(share * bins), F.lit(bins - 1)).cast("long")


def latency_percentiles(events: DataFrame) -> DataFrame:
    return percentile_at(latencies(events), "latency_ms", {"p50": 0.5, "p95": 0.95})


def sparkline(events: DataFrame, bins: int = SPARK_BINS) -> DataFrame:
    """session_id, bin, n: events in equal stretches between a session's first and last arrival, the last bin closed; every bin has a row. An event that is stamped before the first arrival is in none."""
    span = events.groupBy("session_id").agg(F.unix_millis(F.min_by("observed_at", "seq")).alias("first"), F.unix_millis(F.max_by("observed_at", "seq")).alias("last"))
    placed = events.select("session_id", F.unix_millis("observed_at").alias("t")).join(span, "session_id")
    share = (F.col("t") - F.col("first")).cast("double") / F.greatest(F.col("last") - F.col("first"), F.lit(1))
    placed = placed.withColumn("bin", F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")).where("bin >= 0")
    counts = placed.groupBy("session_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    every = span.select("session_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, ["session_id", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def timeline(events: DataFrame, now: Column, minutes: int = TIMELINE_MINUTES) -> DataFrame:
    """bin, n: events of the last `minutes` minutes before `now` by minute, the newest in the last bin; every bin has a row."""
    age = (F.unix_millis(now) - F.unix_millis("observed_at")) / 60000.0
    recent = events.select(age.alias("age")).where((F.col("age") >= 0) & (F.col("age") < minutes))
    counts = recent.groupBy((F.lit(minutes - 1) - F.floor("age")).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = events.sparkSession.range(minutes).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def scaled(rows: DataFrame, value: str = "n", partition: str | None = None) -> DataFrame:
    """Adds height: each value over the largest (at least 1), for drawing."""
    over = Window.partitionBy(partition) if partition else Window.partitionBy()
    return rows.withColumn("height", F.col(value) / F.greatest(F.max(value).over(over), F.lit(1)))


def tool_uses(events: DataFrame) -> DataFrame:
    """A row for each embedded tool use: session_id, seq, observed_at, tool_use_id, tool."""
    both = F.concat(blocks(at(F.col("entry"), "$.content")), blocks(at(F.col("entry"), "$.message.content")))
    uses = events.select("session_id", "seq", "observed_at", F.explode(of_kind(both, "tool_use")).alias("b"))
    return uses.select("session_id", "seq", "observed_at", str_at(F.col("b"), "$.id").alias("tool_use_id"), str_at(F.col("b"), "$.name").alias("tool"))


def tool_results(events: DataFrame) -> DataFrame:
    """A row for each result, embedded or top-level: session_id, seq, observed_at, tool_use_id."""
    top = F.when(F.col("event_type") == "tool_result", F.array_compact(F.array(str_at(F.col("entry"), "$.tool_use_id"))))
    every = F.concat("tool_results", F.coalesce(top, F.array().cast("array<string>")))
    return events.select("session_id", "seq", "observed_at", F.explode(every).alias("tool_use_id"))


def matched_tool_calls(events: DataFrame) -> DataFrame:
    """Extension: each embedded tool use with the first result, embedded or top-level, that carries its id in the same session."""
    uses = tool_uses(events).select("session_id", F.col("seq").alias("use_seq"), "tool_use_id", "tool")
    results = tool_results(events).groupBy("session_id", "tool_use_id").agg(F.min("seq").alias("result_seq"))
    return uses.join(results, ["session_id", "tool_use_id"], "left")
