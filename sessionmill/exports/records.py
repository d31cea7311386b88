"""One training record per session: chat messages, tool-calling chat, or ShareGPT turns.

Each event becomes a few VARIANT messages by column expressions; they are collected in order, and
the record is written as JSON with sorted keys and explicit nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.jsonx import at, blocks, kind, of_kind, str_at, strings_of
from sessionmill.operators.search import content_of

METADATA = (
    "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cost_usd", "first_seen", "last_seen",
    "event_count", "user_count", "assistant_count", "tool_use_count", "tool_result_count", "tool_counts",
)

_NONE = "array<variant>"


def obj(**fields: Column) -> Column:
    return F.to_variant_object(F.struct(*(c.alias(k) for k, c in fields.items())))


def nothing() -> Column:
    return F.array().cast(_NONE)


def body_text(block: Column) -> Column:
    """What a tool gave back: a string as it is, other JSON in compact form, nothing as ''."""
    inner = at(block, "$.content")
    return F.when(kind(inner) == "STRING", str_at(block, "$.content")).otherwise(F.coalesce(F.to_json(inner), F.lit("")))


def text_or(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))


def messages_of(event_type: Column, entry: Column) -> Column:
    """User and assistant messages with their content as it stands."""
    content = content_of(entry)
    user = obj(role=F.lit("user"), content=content, timestamp=F.col("timestamp"))
    assistant = obj(role=F.lit("assistant"), content=content, model=F.col("model"), timestamp=F.col("timestamp"), usage=F.col("usage"))
    return F.when(event_type == "user", F.array(user)).when(event_type == "assistant", F.array(assistant)).otherwise(nothing())


def tool_chat_of(event_type: Column, entry: Column) -> Column:
    """Tool results as messages of their own before the user's text; tool uses as calls of the assistant's message."""
    content = content_of(entry)
    parts = blocks(content)
    said = strings_of(of_kind(parts, "text"), "$.text")
    say = lambda text: F.array(obj(role=F.lit("user"), content=text))
    results = F.transform(
        of_kind(parts, "tool_result"),
        lambda b: obj(role=F.lit("tool"), tool_call_id=text_or(str_at(b, "$.tool_use_id"), ""), content=body_text(b)),
    )
    user = F.when(kind(content) == "STRING", say(str_at(content, "$"))).otherwise(F.concat(results, F.when(F.size(said) > 0, say(F.array_join(said, "\n"))).otherwise(nothing())))

    inner = at(entry, "$.message.content")
    own = blocks(inner)
    texts = F.when(kind(inner) == "STRING", F.array(str_at(inner, "$"))).otherwise(strings_of(of_kind(own, "text"), "$.text"))
    text = F.when(F.size(texts) > 0, F.array_join(texts, "\n"))
    calls = F.transform(
        of_kind(own, "tool_use"),
        lambda b: obj(
            id=text_or(str_at(b, "$.id"), ""),
            type=F.lit("function"),
            function=F.struct(text_or(str_at(b, "$.name"), "").alias("name"), F.coalesce(F.to_json(at(b, "$.input")), F.lit("{}")).alias("arguments")),
        ),
    )
    role, model = F.lit("assistant"), F.col("model")
    some = F.size(calls) > 0
    message = (
        F.when(some & model.isNotNull(), obj(role=role, content=text, tool_calls=calls, model=model))
        .when(some, obj(role=role, content=text, tool_calls=calls))
        .when(model.isNotNull(), obj(role=role, content=text, model=model))
        .otherwise(obj(role=role, content=text))
    )
    assistant = F.when(inner.isNotNull(), F.array(message)).otherwise(nothing())
    return F.when(event_type == "user", user).when(event_type == "assistant", assistant).otherwise(nothing())


def turns_of(event_type: Column, entry: Column) -> Column:
    """ShareGPT turns: human and tool, gpt and function_call; empty ones are left out."""
    content = content_of(entry)
    parts = blocks(content)
    plain = F.when(kind(content) == "STRING", str_at(content, "$")).otherwise(F.array_join(strings_of(of_kind(parts, "text"), "$.text"), "\n"))
    results = F.array_join(F.transform(of_kind(parts, "tool_result"), body_text), "\n")
    used = F.array_join(
        F.transform(
            of_kind(blocks(at(entry, "$.message.content")), "tool_use"),
            lambda b: F.to_json(obj(name=text_or(str_at(b, "$.name"), ""), arguments=at(b, "$.input"))),
        ),
        "\n",
    )
    turn = lambda who, value: F.when(F.coalesce(value, F.lit("")) != "", F.array(F.to_variant_object(F.struct(F.lit(who).alias("from"), value.alias("value"))))).otherwise(nothing())
    user = F.concat(turn("human", plain), turn("tool", results))
    assistant = F.concat(turn("gpt", plain), turn("function_call", used))
    return F.when(event_type == "user", user).when(event_type == "assistant", assistant).otherwise(nothing())


def collected(events: DataFrame, parts: Column) -> DataFrame:
    """session_id and items: the parts of all events of a session in order."""
    rows = events.select("session_id", "seq", parts.alias("parts")).where(F.size("parts") > 0)
    pairs = F.array_sort(
        F.collect_list(F.struct("seq", "parts")),
        lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0),
    )
    return rows.groupBy("session_id").agg(F.flatten(F.transform(pairs, lambda p: p["parts"])).alias("items"))


FORMATS = {
    # name: (parts of an event, name of the list, other fields of the record)
    "messages": (messages_of, "messages", {"session_id": "session_id", "model": "model", "cwd": "cwd", "git_branch": "git_branch", "version": "version", "title": "title"}),
    "openai": (tool_chat_of, "messages", {"session_id": "session_id", "model": "model"}),
    "sharegpt": (turns_of, "conversations", {"id": "session_id", "title": "title", "model": "model"}),
}


def item_texts(events: DataFrame, parts) -> DataFrame:
    """session_id, seq and text: the items of each event that has some, as JSON with commas between them."""
    rows = events.select("session_id", "seq", parts(F.col("event_type"), F.col("entry")).alias("parts")).where(F.size("parts") > 0)
    return rows.select("session_id", "seq", F.array_join(F.transform("parts", lambda x: F.to_json(x)), ",").alias("text"))


def _record(fmt: str, items: Column) -> Column:
    _, list_name, fields = FORMATS[fmt]
    times = {"first_seen", "last_seen"}
    metadata = F.struct(*(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(c) if c in times else F.col(c).alias(c) for c in METADATA))
    record = F.struct(*(F.col(c).alias(k) for k, c in fields.items()), items.alias(list_name), metadata.alias("metadata"))
    return F.to_json(F.to_variant_object(record))


def record_ends(facts: DataFrame, fmt: str) -> DataFrame:
    """session_id, last_seen, head and tail: a session's record and its line end, without its items.

    The record is written with an empty list, whose place is the first such pair of brackets after its name: names before it in the
    record hold text, in which a quote has a backslash before it.
    """
    list_name = FORMATS[fmt][1]
    empty = F.lit(f'"{list_name}":[')
    line = facts.select("session_id", "last_seen", _record(fmt, nothing()).alias("line"))
    cut = F.locate(f'"{list_name}":[]', F.col("line")) + F.length(empty) - 1
    return line.select("session_id", "last_seen", F.left("line", cut).alias("head"), F.concat(F.substr("line", cut + 1), F.lit("\n")).alias("tail"))


def records(events: DataFrame, facts: DataFrame, fmt: str) -> DataFrame:
    """session_id, last_seen and line (the JSON record), for each session of `facts`."""
    items = collected(events, FORMATS[fmt][0](F.col("event_type"), F.col("entry")))
    rows = facts.join(items, "session_id", "left").withColumn("items", F.coalesce("items", nothing()))
    return rows.select("session_id", "last_seen", _record(fmt, F.col("items")).alias("line"))


def raw_lines(events: DataFrame) -> DataFrame:
    """session_id, seq and line: each entry as normalised JSON."""
    return events.select("session_id", "seq", F.to_json("entry").alias("line"))
