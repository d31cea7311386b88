"""From raw log lines to the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.jsonx import at, blocks, count_at, is_kind, number_at, of_kind, parsed_line, str_at, strings_of
from sessionmill.functions.pricing import estimated_cost
from sessionmill.functions.text import cut_to, on_one_line, trim_all

EVENT_COLUMNS = (
    "session_id", "line_index", "entry", "observed_at", "summary", "event_type", "timestamp", "cwd", "git_branch", "version", "model",
    "tool_uses", "tool_results", "usage", "cost_usd", "cost_estimated", "ai_title", "top_tool_name", "source_path", "seq", "event_ts",
)


def usage_of(entry: Column) -> Column:
    """Four token counters, or NULL where all are 0. A null at the first place hides the second."""
    found = F.coalesce(at(entry, "$.message.usage"), at(entry, "$.usage"))
    counts = {
        "input": count_at(found, "$.input_tokens"),
        "output": count_at(found, "$.output_tokens"),
        "cache_read": count_at(found, "$.cache_read_input_tokens"),
        "cache_creation": count_at(found, "$.cache_creation_input_tokens"),
    }
    some = F.lit(False)
    for c in counts.values():
        some = some | (c > 0)
    return F.when(some, F.struct(*(c.alias(name) for name, c in counts.items())))


def shown_text(entry: Column, top: Column, inner: Column) -> Column:
    """The first text that an entry shows; a first hit counts even if it is empty."""
    first = lambda items: F.get(strings_of(of_kind(items, "text"), "$.text"), F.lit(0))
    return F.coalesce(str_at(entry, "$.text"), str_at(entry, "$.content"), first(top), str_at(entry, "$.message.content"), first(inner), F.lit(""))


def told_text(entry: Column, event_type: Column, top: Column, inner: Column) -> Column:
    """The text that a summary previews, and how much of it: a struct of text and limit."""
    text = F.when(event_type == "summary", str_at(entry, "$.summary")).when(event_type == "ai-title", str_at(entry, "$.aiTitle")).otherwise(shown_text(entry, top, inner))
    limit = F.when(event_type == "user", 120).when(event_type == "queue-operation", 80).otherwise(100)
    return F.struct(F.coalesce(text, F.lit("")).alias("text"), limit.alias("limit"))


def summary_of(entry: Column, event_type: Column, shown: Column, top: Column, inner: Column, tool_uses: Column) -> Column:
    """`shown`: the preview of told_text()."""
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    count = lambda name: F.size(of_kind(top, name)) + F.size(of_kind(inner, name))
    or_mark = lambda path: F.coalesce(str_at(entry, path), F.lit("?"))
    tools = F.array_join(tool_uses, ", ")
    results, thoughts = count("tool_result"), count("thinking")
    user = F.when(shown != "", say("👤 ", shown)).when(results > 0, say("📦 Tool result ×", results.cast("string"))).otherwise("👤 User")
    assistant = (
        F.when((F.size(tool_uses) > 0) & (shown == ""), say("🔧 ", tools))
        .when(F.size(tool_uses) > 0, say("🤖 ", shown, " · 🔧 ", tools))
        .when(shown != "", say("🤖 ", shown))
        .when(thoughts > 0, say("💭 Thinking (", thoughts.cast("string"), F.when(thoughts > 1, " blocks)").otherwise(" block)")))
        .otherwise("🤖 Assistant")
    )
    return (
        F.when(event_type == "user", user)
        .when(event_type == "assistant", assistant)
        .when(event_type == "tool_use", say("🔧 ", or_mark("$.name")))
        .when(event_type == "tool_result", say("📦 Tool result: ", or_mark("$.tool_use_id")))
        .when(event_type == "system", say("⚙️  System: ", shown))
        .when(event_type == "summary", say("📝 Summary: ", shown))
        .when(event_type == "attachment", F.lit("📎 Attachment"))
        .when(event_type == "ai-title", say("🏷  ", shown))
        .when(event_type == "queue-operation", say("⏳ Queue ", or_mark("$.operation"), ": ", shown))
        .when(event_type == "last-prompt", F.lit("📍 Last prompt marker"))
        .otherwise(say("❓ ", event_type))
    )


def parsed(lines: DataFrame, keep_bad: bool = False) -> DataFrame:
    """Add `entry` to rows of `raw`. Blank and malformed lines go, or with keep_bad stay with a NULL entry.

    The entry comes out of a generator, which computes it once; a plain column would be computed again by each filter on it.
    """
    line = trim_all(F.col("raw"))
    entry = F.array_compact(F.array(parsed_line(line)))
    return lines.select("*", (F.explode_outer if keep_bad else F.explode)(entry).alias("entry"))


def enriched(lines: DataFrame) -> DataFrame:
    """The event table from rows of source_path, fallback_id, line_index, raw and observed_at.

    Blank and malformed lines give no event. `observed_at` may be null: then the event's own time
    stands for it.
    """
    entry, top, inner = F.col("entry"), F.col("top"), F.col("inner")
    rows = parsed(lines)
    rows = rows.withColumns({"top": blocks(at(entry, "$.content")), "inner": blocks(at(entry, "$.message.content"))})
    both = F.concat(top, inner)
    rows = rows.withColumns(
        {
            "event_type": F.coalesce(str_at(entry, "$.type"), F.lit("unknown")),
            "session_id": F.coalesce(str_at(entry, "$.sessionId"), F.col("fallback_id")),
            "timestamp": str_at(entry, "$.timestamp"),
            "cwd": str_at(entry, "$.cwd"),
            "git_branch": str_at(entry, "$.gitBranch"),
            "version": str_at(entry, "$.version"),
            "model": F.coalesce(str_at(entry, "$.message.model"), str_at(entry, "$.model")),
            "tool_uses": strings_of(of_kind(both, "tool_use"), "$.name"),
            "tool_results": strings_of(of_kind(both, "tool_result"), "$.tool_use_id"),
            "usage": usage_of(entry),
            "given_cost": number_at(entry, "$.costUSD"),
        }
    )
    event_type = F.col("event_type")
    rows = rows.withColumn("told", told_text(entry, event_type, top, inner))
    rows = rows.withColumn("flat", on_one_line(F.col("told.text")))
    rows = rows.withColumns(
        {
            "cost_usd": F.coalesce(F.col("given_cost"), F.when(F.col("usage").isNotNull(), estimated_cost(F.col("model"), F.col("usage"))), F.lit(0.0)),
            "cost_estimated": F.col("given_cost").isNull(),
            "summary": summary_of(entry, event_type, cut_to(F.col("flat"), F.col("told.limit")), top, inner, F.col("tool_uses")),
            "ai_title": F.when(event_type == "ai-title", str_at(entry, "$.aiTitle")),
            "top_tool_name": F.when(event_type == "tool_use", str_at(entry, "$.name")),
            "seq": F.struct("source_path", "line_index"),
            "given_ts": F.try_to_timestamp("timestamp"),
        }
    )
    observed = F.coalesce("observed_at", "given_ts")
    rows = rows.withColumns({"event_ts": F.coalesce(F.col("given_ts"), observed), "observed_at": observed})
    return rows.select(*EVENT_COLUMNS)
