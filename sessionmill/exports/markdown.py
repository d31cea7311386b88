"""A session as a Markdown transcript."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionmill.functions.jsonx import at, blocks, kind, str_at
from sessionmill.functions.text import format_cost
from sessionmill.operators.search import content_of


@F.pandas_udf(T.ArrayType(T.StringType()))
def indented(texts: pd.Series) -> pd.Series:
    """JSON texts on several lines; nulls stay."""

    def one(text):
        return None if text is None else json.dumps(json.loads(text), indent=2, ensure_ascii=False)

    return texts.map(lambda row: None if row is None else [one(t) for t in row])


def _shown(content: Column, pretty: Column) -> Column:
    """The text of a message; `pretty` has the indented JSON of each block that needs it."""

    def block(b: Column, body: Column) -> Column:
        name = str_at(b, "$.type")
        raw = F.when(kind(at(b, "$.content")) == "STRING", str_at(b, "$.content")).otherwise(F.coalesce(body, F.lit("")))
        # As in the record exports, a null is a value: only a missing key falls back.
        thought = F.coalesce(str_at(F.coalesce(at(b, "$.thinking"), at(b, "$.text")), "$"), F.lit(""))
        return (
            F.when(name == "text", F.coalesce(F.concat(str_at(b, "$.text"), F.lit("\n\n")), F.lit("")))
            .when(name == "thinking", F.concat(F.lit("<details><summary>💭 Thinking</summary>\n\n```\n"), thought, F.lit("\n```\n\n</details>\n")))
            .when(name == "tool_use", F.concat(F.lit("**🔧 Tool: `"), F.coalesce(str_at(b, "$.name"), F.lit("?")), F.lit("`**\n\n```json\n"), F.coalesce(body, F.lit("null")), F.lit("\n```\n\n")))
            .when(name == "tool_result", F.concat(F.lit("**📦 Tool result** (`"), F.coalesce(str_at(b, "$.tool_use_id"), F.lit("")), F.lit("`)\n\n```\n"), raw, F.lit("\n```\n\n")))
            .otherwise("")
        )

    listed = F.array_join(F.zip_with(blocks(content), pretty, block), "")
    return F.coalesce(F.when(kind(content) == "STRING", F.concat(str_at(content, "$"), F.lit("\n"))).otherwise(listed), F.lit(""))


def pieces(events: DataFrame) -> DataFrame:
    """session_id, seq and piece: the text of each event that has one."""
    entry, event_type = F.col("entry"), F.col("event_type")
    rows = events.where(event_type.isin("user", "assistant", "summary"))
    content = F.when(event_type == "assistant", at(entry, "$.message.content")).otherwise(content_of(entry))
    rows = rows.select("session_id", "seq", "event_type", "timestamp", F.when(event_type == "summary", str_at(entry, "$.summary")).alias("told"), content.alias("content"))
    to_indent = lambda b: F.when(str_at(b, "$.type") == "tool_use", F.to_json(at(b, "$.input"))).when((str_at(b, "$.type") == "tool_result") & (kind(at(b, "$.content")) != "STRING"), F.to_json(at(b, "$.content")))
    rows = rows.withColumn("pretty", indented(F.transform(blocks(F.col("content")), to_indent)))
    stamp = F.coalesce(F.concat(F.lit("*"), F.col("timestamp"), F.lit("*\n")), F.lit(""))
    body = _shown(F.col("content"), F.col("pretty"))
    piece = (
        F.when(event_type == "user", F.concat(F.lit("## 👤 User\n\n"), body, F.lit("\n")))
        .when(event_type == "assistant", F.concat(F.lit("## 🤖 Assistant\n"), stamp, F.lit("\n"), body, F.lit("\n")))
        .otherwise(F.concat(F.lit("> **Summary:** "), F.col("told"), F.lit("\n\n")))
    )
    return rows.select("session_id", "seq", piece.alias("piece")).where("piece is not null")


def headings(facts: DataFrame) -> DataFrame:
    """session_id, last_seen and head: what stands above a session's events."""
    line = lambda label, c, mark="": F.coalesce(F.concat(F.lit(f"- **{label}:** {mark}"), c, F.lit(f"{mark}\n")), F.lit(""))
    head = F.concat(
        F.lit("# "),
        F.coalesce("title", F.concat(F.lit("Session "), F.col("session_id"))),
        F.lit("\n\n"),
        line("ID", F.col("session_id"), "`"),
        line("Model", F.col("model")),
        line("CWD", F.col("cwd"), "`"),
        line("Branch", F.col("git_branch"), "`"),
        F.format_string("- **Events:** %d · **Cost (est.):** %s · **Tokens out:** %d\n\n", F.col("event_count"), format_cost(F.col("cost_usd")), F.col("output_tokens")),
    )
    return facts.select("session_id", "last_seen", head.alias("head"))


def transcripts(events: DataFrame, facts: DataFrame) -> DataFrame:
    """session_id, last_seen and text, for each session of `facts`."""
    own = pieces(events).select("session_id", F.struct("seq", "piece").alias("p"))
    told = own.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "").alias("told"))
    return headings(facts).join(told, "session_id", "left").select("session_id", "last_seen", F.concat("head", F.coalesce("told", F.lit(""))).alias("text"))
