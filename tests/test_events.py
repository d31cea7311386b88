import json
import random

import pytest
from helpers import events_of, one
from pyspark.sql import functions as F

from sessionmill.functions.jsonx import parsed_line
from sessionmill.functions.text import format_latency, how_long_ago, preview, project_name, short_filename, short_id


def test_one_line_of_a_question(spark):
    e = one(spark, {"type": "user", "content": "  which bulbs\nflower in March?  "})
    assert e.summary == "👤 which bulbs flower in March?" and e.usage is None and e.tool_uses == []


def test_an_answer_that_uses_two_tools(spark):
    content = [{"type": "tool_use", "id": "u7", "name": "almanac", "input": {"month": 3}}, {"type": "text", "text": "Looking it up"}, {"type": "tool_use", "id": "u8", "name": "seed_catalogue"}]
    e = one(spark, {"type": "assistant", "message": {"content": content, "usage": {"input_tokens": 812, "output_tokens": 37}}})
    assert e.tool_uses == ["almanac", "seed_catalogue"] and e.summary == "🤖 Looking it up · 🔧 almanac, seed_catalogue"
    assert (e.usage.input, e.usage.output, e.usage.cache_read, e.usage.cache_creation) == (812, 37, 0, 0)


def each(spark, entries):
    """The events of these entries, one each."""
    rows = {e.line_index: e for e in events_of(spark, *entries).collect()}
    return [rows[i] for i in range(len(entries))]


def test_session_id_only_from_a_string(spark):
    cases = [("allotment-12", "allotment-12"), (12, "file"), (None, "file"), ("", ""), (["allotment-12"], "file"), (" x ", " x ")]
    assert [e.session_id for e in each(spark, [{"sessionId": given} for given, _ in cases])] == [want for _, want in cases]


COSTS = [
    ("sonnet-9", {"input_tokens": 250_000, "output_tokens": 2_000}, None, 0.78, True),
    ("my-OPUS-copy", {"output_tokens": 40_000, "cache_read_input_tokens": 200_000}, None, 3.3, True),
    ("haiku", {"cache_read_input_tokens": 300_000, "cache_creation_input_tokens": 80_000}, None, 0.13, True),
    (None, {"input_tokens": 20_000, "cache_creation_input_tokens": 8_000}, None, 0.09, True),
    ("sonnet-9", {"input_tokens": 250_000}, 0.031, 0.031, False),
    ("sonnet-9", {"input_tokens": 250_000}, 0, 0.0, False),
    ("sonnet-9", {"input_tokens": 250_000}, "0.031", 0.75, True),
    (None, None, None, 0.0, True),
]


def test_cost(spark):
    entries = [{"type": "assistant", "costUSD": given, "message": {"model": model, "usage": usage}} for model, usage, given, _, _ in COSTS]
    for e, (*_, cost, estimated) in zip(each(spark, entries), COSTS, strict=True):
        assert e.cost_usd == pytest.approx(cost) and e.cost_estimated is estimated


def test_counters_are_strict(spark):
    usage = {"input_tokens": 3.0, "output_tokens": -1, "cache_read_input_tokens": "7", "cache_creation_input_tokens": 2}
    assert tuple(one(spark, {"usage": usage}).usage) == (0, 0, 0, 2)
    assert one(spark, {"usage": dict.fromkeys(usage, 0)}).usage is None


def test_null_hides_the_fallback_but_missing_does_not(spark):
    assert one(spark, {"message": {"usage": None}, "usage": {"input_tokens": 1}}).usage is None
    assert one(spark, {"message": {}, "usage": {"input_tokens": 1}}).usage.input == 1
    assert one(spark, {"message": {"model": None}, "model": "m"}).model == "m"


SUMMARIES = [
    ({"type": "tool_use", "name": "prune_hedge"}, "🔧 prune_hedge"),
    ({"type": "tool_use"}, "🔧 ?"),
    ({"type": "tool_result", "tool_use_id": "t"}, "📦 Tool result: t"),
    ({"type": "summary", "summary": "Spring beds planned"}, "📝 Summary: Spring beds planned"),
    ({"type": "summary"}, "📝 Summary: "),
    ({"type": "system", "content": "x"}, "⚙️  System: x"),
    ({"type": "attachment"}, "📎 Attachment"),
    ({"type": "ai-title", "aiTitle": "T"}, "🏷  T"),
    ({"type": "queue-operation", "operation": "add", "content": "y"}, "⏳ Queue add: y"),
    ({"type": "last-prompt"}, "📍 Last prompt marker"),
    ({"type": "odd"}, "❓ odd"),
    ({"type": 5}, "❓ unknown"),
    ({"type": "user"}, "👤 User"),
    ({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "u7"}, {"type": "tool_result", "tool_use_id": "u8"}]}}, "📦 Tool result ×2"),
    ({"type": "assistant"}, "🤖 Assistant"),
    ({"type": "assistant", "message": {"content": [{"type": "thinking"}, {"type": "thinking"}]}}, "💭 Thinking (2 blocks)"),
    ({"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "A"}, {"type": "tool_use", "name": "B"}]}}, "🔧 A, B"),
    ({"type": "user", "content": "", "message": {"content": "hidden"}}, "👤 User"),
    ({"type": "user", "content": [{"type": "text", "text": 5}, {"type": "text", "text": "b"}]}, "👤 b"),
]


def test_summaries(spark):
    assert [e.summary for e in each(spark, [entry for entry, _ in SUMMARIES])] == [summary for _, summary in SUMMARIES]


def test_tools_come_from_both_places_top_first(spark):
    e = one(spark, {"content": [{"type": "tool_use", "name": "T"}], "message": {"content": [{"type": "tool_use", "name": "M"}, {"type": "tool_use", "name": 1}, {"type": "tool_result", "tool_use_id": "r"}]}})
    assert e.tool_uses == ["T", "M"] and e.tool_results == ["r"]


def cut(s, n):
    s = s.strip().replace("\n", " ")
    if len(s) <= n:
        return s
    b = s.encode()[:n]
    while True:
        try:
            return b.decode() + "…"
        except UnicodeDecodeError:
            b = b[:-1]


def test_preview_counts_characters_and_cuts_bytes(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aé€😀 \n\u00a0") for _ in range(rng.randrange(40))) for _ in range(300)] + ["é" * 121, "a" * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for n in (7, 12, 120):
        got = {r.i: r.p for r in df.select("i", preview(F.col("t"), n).alias("p")).collect()}
        assert [got[i] for i in range(len(texts))] == [cut(t, n) for t in texts]
    assert cut("é" * 121, 120) == "é" * 60 + "…"


STRICT = [(x, True) for x in ('{"a":1}', "[1]", '"s"', "3")] + [(x, False) for x in ("{} x", "1,2", "bad", "{}]", "1}", '1,"f":2', "NaN", "[1],[2", '1,"<end of line>"],[3', '1,"<end of line>"')]
STRICT += [('"<end of line>"', True), ('{"a":"<end of line>"}', True)]


def test_strict_lines(spark):
    rows = spark.createDataFrame(STRICT, "x string, ok boolean").select("x", "ok", parsed_line(F.col("x")).isNotNull().alias("got")).collect()
    assert all(r.ok == r.got for r in rows)


def test_malformed_and_blank_lines_give_no_event(spark):
    assert [e.line_index for e in events_of(spark, "{bad", "  ", '{"type":"user"}').collect()] == [2]


def test_duplicate_keys_last_wins(spark):
    assert one(spark, '{"type":"user","type":"system"}').event_type == "system"


def test_names_and_formats(spark):
    df = spark.createDataFrame([("abcdefghijklmnopq", "/a/b//", 61_500), ("a b/ü", "C:\\x\\y", 999), ("s", None, 1500)], "id string, cwd string, ms long")
    rows = df.select(short_id(F.col("id")), short_filename(F.col("id")), project_name(F.col("cwd")), format_latency(F.col("ms"))).collect()
    assert [tuple(r) for r in rows] == [("abcdefgh…nopq", "abcdefghijklmnopq", "b", "1m 2s"), ("a b/ü", "a-b-ü", "y", "999ms"), ("s", "s", "(unknown project)", "1.5s")]
    ago = spark.range(1).select(*(how_long_ago(F.timestamp_seconds(F.lit(1000)), F.timestamp_seconds(F.lit(1000 + s))).alias(str(s)) for s in (4, 59, 61, 7200, 90000))).first()
    assert tuple(ago) == ("now", "59s", "1m", "2h", "1d")


def test_event_json_round_trip(spark):
    entry = {"b": [1, {"c": None}], "a": "x"}
    got = events_of(spark, entry).select(F.to_json("entry").alias("j")).first().j
    assert json.loads(got) == entry
