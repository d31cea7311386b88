"""The event feed, filters and free-text search. All text matching is literal, without case."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.jsonx import at, blocks, is_kind, kind, str_at
from sessionmill.functions.text import short_id

PALETTE_LIMIT = 60


def has(haystack: Column, needle: str) -> Column:
    return F.contains(F.lower(haystack), F.lit(needle.lower())) if needle else F.lit(True)


def of_feed_type(name: str) -> Column:
    """`all`, an event type, or `tool_use` and `tool_result`, which also match events that embed one."""
    if name == "all":
        return F.lit(True)
    same = F.col("event_type") == name
    embedded = {"tool_use": "tool_uses", "tool_result": "tool_results"}.get(name)
    return same | (F.size(embedded) > 0) if embedded else same


def searchable(events: DataFrame) -> DataFrame:
    """Adds search_text, lower-cased once, so that a stored event table need not turn entries into text again for each search. Entries may be JSON text already."""
    entry = F.col("entry") if events.schema["entry"].dataType.typeName() == "string" else F.to_json("entry")
    return events.withColumn("search_text", F.lower(F.concat_ws(" ", "summary", "session_id", F.array_join("tool_uses", " "), entry)))


@dataclass(frozen=True)
class FilterSpec:
    """A saved view: what the feed shows and which sessions are listed."""

    type: str = "all"
    search: str = ""
    session: str | None = None
    session_filter: str = ""

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> FilterSpec:
        return FilterSpec(**json.loads(text))


def feed(events: DataFrame, view: FilterSpec = FilterSpec()) -> DataFrame:  # noqa: B008
    """The events that a view shows."""
    rows = events.where(of_feed_type(view.type))
    if view.session is not None:
        rows = rows.where(F.col("session_id") == view.session)
    if view.search:
        rows = rows if "search_text" in rows.columns else searchable(rows)
        rows = rows.where(F.contains("search_text", F.lit(view.search.lower())))
    return rows


def feed_rows(events: DataFrame) -> DataFrame:
    """What one line of the feed shows."""
    u = F.col("usage")
    taken = u["input"] + u["cache_read"] + u["cache_creation"]
    tokens = F.when(u.isNotNull(), F.concat(taken.cast("string"), F.lit("↑ "), u["output"].cast("string"), F.lit("↓")))
    return events.select(
        short_id(F.col("session_id")).alias("session"), "line_index", "event_type", "summary", tokens.alias("tokens"), "cost_usd", F.date_format("observed_at", "HH:mm:ss").alias("time")
    )


def event_detail(events: DataFrame) -> DataFrame:
    """All derived fields of an event and its entry as JSON."""
    return events.select("session_id", "line_index", "event_type", "timestamp", "observed_at", "cwd", "git_branch", "version", "model", "tool_uses", "tool_results", "usage", "cost_usd", "cost_estimated", "summary", F.to_json("entry").alias("entry_json"))


def search_sessions(facts: DataFrame, text: str = "", bookmarked_only: bool = False) -> DataFrame:
    """Sessions whose id, folder, title, branch or tags hold the text. `bookmarked` and `tags` are used if present."""
    fields = ["session_id", "cwd", "title", "git_branch"] + (["tags"] if "tags" in facts.columns else [])
    joined = F.concat_ws(" ", *(F.array_join(c, " ") if c == "tags" else F.col(c) for c in fields))
    rows = facts.where(has(joined, text))
    return rows.where("bookmarked") if bookmarked_only else rows


def palette(facts: DataFrame, text: str, limit: int = PALETTE_LIMIT) -> DataFrame:
    """The first sessions, most recent first, whose id, title or folder holds the text."""
    found = facts.where(has(F.concat_ws(" ", "session_id", "title", "cwd"), text))
    return found.orderBy(F.desc("last_seen"), "session_id").limit(limit)


def content_of(entry: Column) -> Column:
    """A message's content; the top-level one only where the inner one is missing, not where it is null."""
    return F.coalesce(at(entry, "$.message.content"), at(entry, "$.content"))


def content_parts(entry: Column) -> Column:
    """An array of (kind, text, name, id, body) for a message: a string is one text part."""
    content = content_of(entry)

    def part(b: Column) -> Column:
        name = str_at(b, "$.type")
        inner = at(b, "$.content")
        body = F.when(kind(inner) == "STRING", str_at(b, "$.content")).otherwise(F.to_json(inner))
        return F.struct(
            F.when(name.isin("text", "thinking", "tool_use", "tool_result", "image"), name).otherwise("other").alias("kind"),
            F.when(name == "thinking", F.coalesce(str_at(b, "$.thinking"), str_at(b, "$.text"))).when(name == "text", str_at(b, "$.text")).alias("text"),
            F.when(name == "tool_use", str_at(b, "$.name")).alias("name"),
            F.when(name == "tool_use", str_at(b, "$.id")).when(name == "tool_result", str_at(b, "$.tool_use_id")).alias("id"),
            F.when(name == "tool_use", F.to_json(at(b, "$.input"))).when(name == "tool_result", body).alias("body"),
        )

    nothing = F.lit(None).cast("string")
    plain = F.array(F.struct(F.lit("text").alias("kind"), str_at(content, "$").alias("text"), nothing.alias("name"), nothing.alias("id"), nothing.alias("body")))
    return F.when(kind(content) == "STRING", plain).otherwise(F.transform(blocks(content), part))


def only_tool_results(entry: Column) -> Column:
    """A message of nothing but tool results, which holds for an empty array too."""
    content = content_of(entry)
    return F.coalesce(F.startswith(kind(content), F.lit("ARRAY")), F.lit(False)) & F.forall(blocks(content), lambda b: is_kind(b, "tool_result"))


def conversation(events: DataFrame) -> DataFrame:
    """The messages of user, assistant, system and summary events with their parts."""
    entry = F.col("entry")
    rows = events.where(F.col("event_type").isin("user", "assistant", "system", "summary"))
    return rows.select(
        "session_id",
        "seq",
        F.col("event_type").alias("role"),
        F.when(F.col("event_type") == "summary", str_at(entry, "$.summary")).alias("summary_text"),
        content_parts(entry).alias("parts"),
        only_tool_results(entry).alias("only_tool_results"),
        "timestamp",
        "model",
        "cost_usd",
    )
