"""Other tables as session logs: each row becomes one raw JSON line, which then goes the usual way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.functions.events import enriched

MODELS = ("opus-large", "haiku-small", "sonnet-medium", "other-model")


def conversation_lines(conversations: DataFrame) -> DataFrame:
    """A turn as a message whose usage is its length in characters (input) and its number (output)."""
    c = F.col
    block = F.struct(F.lit("text").alias("type"), c("text").alias("text"))
    usage = F.struct(F.char_length("text").cast("long").alias("input_tokens"), c("turn").alias("output_tokens"))
    model = F.element_at(F.array(*(F.lit(m) for m in MODELS)), (F.pmod(c("conv_id"), F.lit(4)) + 1).cast("int"))
    message = F.struct(c("role").alias("role"), model.alias("model"), F.array(block).alias("content"), usage.alias("usage"))
    line = F.struct(c("role").alias("type"), F.concat(F.lit("conv-"), c("conv_id").cast("string")).alias("sessionId"), message.alias("message"))
    # A made-up clock: turns of a conversation are a minute apart.
    at = F.timestamp_seconds(F.lit(1_700_000_000) + c("conv_id") * 3600 + c("turn") * 60)
    return conversations.select(F.lit("conversations").alias("source_path"), F.lit("conversations").alias("fallback_id"), c("turn").alias("line_index"), F.to_json(line).alias("raw"), at.alias("observed_at"))


def block_lines(conversations: DataFrame) -> DataFrame:
    """A turn as a message of one of six contents in turn: a string, text and a tool use, a tool result, thinking and text, a result of JSON with text, and kinds without text before text."""
    c = F.col
    quoted = lambda x: F.expr(f"substr(to_json(array({x})), 2, length(to_json(array({x}))) - 2)")
    text, use = quoted("text"), F.concat(F.lit("t"), c("conv_id").cast("string"), F.lit("-"), c("turn").cast("string"))
    said = F.concat(F.lit('{"type":"text","text":'), text, F.lit("}"))
    number = F.concat(F.lit('{"n":'), c("turn").cast("string"), F.lit("}"))
    used = F.concat(F.lit('{"type":"tool_use","name":"look","id":"'), use, F.lit('","input":'), number, F.lit("}"))
    result = lambda body: F.concat(F.lit('{"type":"tool_result","tool_use_id":"'), use, F.lit('","content":'), body, F.lit("}"))
    several = lambda *x: F.concat(F.lit("["), F.concat_ws(",", *x), F.lit("]"))
    contents = (
        text, several(said, used), several(result(text)), several(F.concat(F.lit('{"type":"thinking","thinking":'), text, F.lit("}")), said), several(result(number), said),
        several(F.lit('{"type":"image","source":{}}'), F.lit('{"type":"chart"}'), said),
    )
    kind = F.pmod(c("conv_id") + c("turn"), F.lit(len(contents)))
    content = F.coalesce(*(F.when(kind == i, x) for i, x in enumerate(contents)))
    raw = F.concat(F.lit('{"type":"'), c("role"), F.lit('","sessionId":"conv-'), c("conv_id").cast("string"), F.lit('","message":{"content":'), content, F.lit("}}"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + c("conv_id") * 3600 + c("turn") * 60)
    return conversations.select(F.lit("conversations").alias("source_path"), F.lit("conversations").alias("fallback_id"), c("turn").alias("line_index"), raw.alias("raw"), at.alias("observed_at"))


def event_lines(events: DataFrame, call: str = "event_id") -> DataFrame:
    """A user's clicks as user messages, views as assistant messages that use a tool, purchases as top-level tool uses, errors as tool results, sign-ups as system events.

    `call`: what the ids of tool uses and results are made of, event_id or k (a number in props, by which results can meet uses).
    """
    c = F.col
    k = F.get_json_object("props", "$.k").cast("long")
    rows = events.withColumn("k", k).withColumn("n", F.concat(F.lit("tool"), F.pmod("k", F.lit(12)).cast("string")))
    kind = F.create_map(*(F.lit(x) for x in ("click", "user", "view", "assistant", "purchase", "tool_use", "error", "tool_result", "signup", "system")))
    event_type = F.try_element_at(kind, c("event_type"))
    text = F.concat(F.lit("event "), c("event_id").cast("string"))
    use = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), c("n").alias("name"), F.concat(F.lit("t"), c(call).cast("string")).alias("id"))
    said = F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("id"))
    model = F.element_at(F.array(*(F.lit(m) for m in MODELS)), (F.pmod(c("event_id"), F.lit(4)) + 1).cast("int"))
    usage = F.struct(c("k").alias("input_tokens"), (c("k") * 2).alias("output_tokens"), F.pmod("k", F.lit(5)).alias("cache_read_input_tokens"), F.pmod("k", F.lit(3)).alias("cache_creation_input_tokens"))
    user = F.struct(F.lit("user").alias("role"), F.lit(None).cast("string").alias("model"), F.array(said).alias("content"), F.lit(None).cast(usage_type()).alias("usage"))
    assistant = F.struct(F.lit("assistant").alias("role"), model.alias("model"), F.array(said, use).alias("content"), usage.alias("usage"))
    line = F.struct(
        event_type.alias("type"),
        F.concat(F.lit("u"), c("user_id").cast("string")).alias("sessionId"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.when(F.pmod("event_id", F.lit(7)) != 0, F.concat(F.lit("/work/p"), F.pmod("user_id", F.lit(10)).cast("string"))).alias("cwd"),
        F.when(F.pmod("event_id", F.lit(5)) == 0, F.concat(F.lit("b"), F.pmod("k", F.lit(3)).cast("string"))).alias("gitBranch"),
        F.when(F.pmod("event_id", F.lit(3)) != 0, c("value")).alias("costUSD"),
        F.when(c("event_type") == "purchase", c("n")).alias("name"),
        F.when(c("event_type") == "error", F.concat(F.lit("t"), c(call).cast("string"))).alias("tool_use_id"),
        F.when(c("event_type") == "click", user).when(c("event_type") == "view", assistant).alias("message"),
    )
    rows = rows.select(F.lit("events").alias("source_path"), F.lit("events").alias("fallback_id"), c("event_id").alias("line_index"), F.to_json(line).alias("raw"), c("ts").cast("timestamp").alias("observed_at"))
    return rows


def usage_type() -> str:
    return "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>"


def spread(rows: DataFrame) -> DataFrame:
    """Over all cores, where a table has fewer parts: parsing costs far more than moving the base columns. A table of many parts is left alone."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def events_table(spark: SparkSession, sf_dir: str, call: str = "event_id") -> DataFrame:
    return enriched(event_lines(spread(spark.read.parquet(f"{sf_dir}/events.parquet")), call))


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share; a local one only where none is named and Spark is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    return f"{named}/{uuid.uuid4().hex}"


def conversations_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(conversation_lines(spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def blocks_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(block_lines(spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
