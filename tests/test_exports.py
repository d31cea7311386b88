import json
import os
from datetime import datetime

import pytest
from helpers import events_of
from pyspark.sql import functions as F

from sessionmill.__main__ import main
from sessionmill.exports.write import BETWEEN_TRANSCRIPTS, export_filename, exported, preview_text, stream_text, write_dataset
from sessionmill.operators import sessions as S


SID = "hedge/7 é"


def turn(kind, said, **more):
    return {"type": kind, "sessionId": SID, "message": said, **more}


ASKED = "When do I cut the hedge?"
CALL = {"type": "tool_use", "id": "c-1", "name": "calendar", "input": {"crop": "box", "zone": 8}}
GARDEN = [
    {"type": "ai-title", "sessionId": SID, "aiTitle": "Hedge care"},
    turn("user", {"content": ASKED}, cwd="/home/g/garden", version="2.1"),
    turn("assistant", {"model": "haiku-mini", "content": [CALL, {"type": "text", "text": "A moment."}], "usage": {"input_tokens": 64, "output_tokens": 12, "cache_read_input_tokens": 1000}}, timestamp="2025-06-01T08:30:00Z"),
    turn("user", {"content": [{"type": "tool_result", "tool_use_id": "c-1", "content": {"months": [6, 9]}}, {"type": "text", "text": "and then?"}]}),
    turn("assistant", {"model": "haiku-mini", "content": "In June, again in September."}, gitBranch="wip"),
]


def lines(spark, entries, fmt, **options):
    events = events_of(spark, *entries)
    return [r.line for r in exported(events, S.sessions(events), fmt, **options).collect()]


def test_messages(spark):
    (line,) = lines(spark, GARDEN, "messages")
    r = json.loads(line)
    assert list(r) == sorted(r)
    assert [(m["role"], m["content"]) for m in r["messages"]] == [(e["type"], e["message"]["content"]) for e in GARDEN[1:]]
    first, call, _, last = r["messages"]
    assert set(first) == {"role", "content", "timestamp"} and first["timestamp"] is None
    assert set(call) == {"role", "content", "timestamp", "model", "usage"} and call["timestamp"] == "2025-06-01T08:30:00Z" and call["model"] == "haiku-mini"
    assert call["usage"] == {"input": 64, "output": 12, "cache_read": 1000, "cache_creation": 0} and last["usage"] is None
    assert {k: r[k] for k in ("session_id", "title", "cwd", "version", "git_branch", "model")} == {"session_id": SID, "title": "Hedge care", "cwd": "/home/g/garden", "version": "2.1", "git_branch": "wip", "model": "haiku-mini"}
    counts = {"input_tokens": 64, "output_tokens": 12, "cache_read_tokens": 1000, "cache_creation_tokens": 0, "event_count": 5, "user_count": 2, "assistant_count": 2, "tool_use_count": 1, "tool_result_count": 1, "tool_counts": {"calendar": 1}}
    assert {k: v for k, v in r["metadata"].items() if k in counts} == counts
    assert set(r["metadata"]) == {*counts, "cost_usd", "first_seen", "last_seen"} and r["metadata"]["cost_usd"] == pytest.approx((64 + 12 * 5 + 100) / 1e6)


def test_openai(spark):
    odd = [{"type": "tool_result", "tool_use_id": "c-2", "content": [1, {"b": None}]}, {"type": "text", "text": "one"}, {"type": "tool_result", "content": None}, {"type": "tool_result"}, {"type": "picture"}, {"type": "text", "text": "two"}]
    more = [turn("user", {"content": odd}), turn("assistant", {"content": None}), {"type": "assistant", "sessionId": SID, "content": "from the top"}, turn("user", {"content": 3.5}), turn("assistant", {"content": [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use"}]})]
    (line,) = lines(spark, GARDEN + more, "openai")
    got = json.loads(line)["messages"]
    call = {"id": "c-1", "type": "function", "function": {"name": "calendar", "arguments": '{"crop":"box","zone":8}'}}
    assert got[:5] == [
        {"role": "user", "content": ASKED},
        {"role": "assistant", "content": "A moment.", "model": "haiku-mini", "tool_calls": [call]},
        {"role": "tool", "tool_call_id": "c-1", "content": '{"months":[6,9]}'},
        {"role": "user", "content": "and then?"},
        {"role": "assistant", "content": "In June, again in September.", "model": "haiku-mini"},
    ]
    assert got[5:9] == [{"role": "tool", "tool_call_id": i, "content": c} for i, c in (("c-2", '[1,{"b":null}]'), ("", "null"), ("", ""))] + [{"role": "user", "content": "one\ntwo"}]
    # Content at the top of an entry, and content that is no text, say nothing in this format.
    nameless = {"id": "", "type": "function", "function": {"name": "", "arguments": "{}"}}
    assert got[9:] == [{"role": "assistant", "content": None}, {"role": "assistant", "content": None, "tool_calls": [nameless]}]


def test_sharegpt(spark):
    more = [turn("user", {"content": [{"type": "tool_result"}, {"type": "tool_result"}, {"type": "tool_result", "content": "x"}]}), {"type": "assistant", "sessionId": SID, "content": "from the top"}, turn("user", {"content": ""})]
    (line,) = lines(spark, GARDEN + more, "sharegpt")
    r = json.loads(line)
    said = [(t["from"], t["value"]) for t in r["conversations"]]
    assert r["id"] == SID and sorted(said[1:3]) == [("function_call", '{"arguments":{"crop":"box","zone":8},"name":"calendar"}'), ("gpt", "A moment.")]
    assert said[0] == ("human", ASKED) and sorted(said[3:5]) == [("human", "and then?"), ("tool", '{"months":[6,9]}')]
    assert said[5:] == [("gpt", "In June, again in September."), ("tool", "\n\nx"), ("gpt", "from the top")]


def test_raw(spark):
    assert [json.loads(x) for x in lines(spark, GARDEN, "jsonl")] == GARDEN
    assert [json.loads(x) for x in lines(spark, GARDEN, "jsonl", max_events=2)] == GARDEN[-2:]


def test_markdown(spark):
    odd = [{"type": "thinking", "text": "wet soil"}, {"type": "tool_use", "name": "hose", "input": {"minutes": [10, 20], "où": "là"}}, {"type": "tool_result", "tool_use_id": "c-9", "content": "done"}, {"type": "sketch"}]
    (text,) = lines(spark, [*GARDEN, turn("assistant", {"content": odd}), {"type": "summary", "sessionId": SID, "summary": "Cut twice"}, {"type": "system", "sessionId": SID}], "markdown")
    head, *parts = text.split("## ")
    assert head == f"# Hedge care\n\n- **ID:** `{SID}`\n- **Model:** haiku-mini\n- **CWD:** `/home/g/garden`\n- **Branch:** `wip`\n- **Events:** 8 · **Cost (est.):** $0.0002 · **Tokens out:** 12\n\n"
    assert [p.split("\n")[0] for p in parts] == ["👤 User", "🤖 Assistant", "👤 User", "🤖 Assistant", "🤖 Assistant"]
    assert parts[0] == f"👤 User\n\n{ASKED}\n\n"
    call = '**🔧 Tool: `calendar`**\n\n```json\n{\n  "crop": "box",\n  "zone": 8\n}\n```\n'
    assert parts[1].startswith("🤖 Assistant\n*2025-06-01T08:30:00Z*\n\n") and call in parts[1] and "\nA moment.\n" in parts[1]
    assert '**📦 Tool result** (`c-1`)\n\n```\n{\n  "months": [\n    6,\n    9\n  ]\n}\n```\n' in parts[2] and "and then?\n" in parts[2]
    for piece in ("<details><summary>💭 Thinking</summary>\n\n```\nwet soil\n```\n\n</details>\n", '```json\n{\n  "minutes": [\n    10,\n    20\n  ],\n  "où": "là"\n}\n```\n', "**📦 Tool result** (`c-9`)\n\n```\ndone\n```\n"):
        assert piece in parts[4]
    assert text.endswith("> **Summary:** Cut twice\n\n") and "sketch" not in text


def test_several_sessions(spark):
    two = [*GARDEN, {"type": "user", "sessionId": "b", "content": "x"}]
    assert len(lines(spark, two, "messages")) == 2
    events = events_of(spark, *two)
    rows = exported(events, S.sessions(events), "markdown")
    text = "".join(stream_text(rows, "markdown"))
    assert text.count(BETWEEN_TRANSCRIPTS) == 1 and text.startswith("# Session b\n")
    assert preview_text(rows, "markdown", 10) == text[:10]
    with pytest.raises(ValueError):
        exported(events, S.sessions(events), "pdf")


@pytest.mark.parametrize("one_file", [False, True])
def test_dataset(spark, tmp_path, one_file):
    events = events_of(spark, *GARDEN, {"type": "user", "sessionId": "b", "content": "x"})
    write_dataset(events, S.sessions(events), f"{tmp_path}/d", one_file=one_file)
    assert sorted(x for x in os.listdir(f"{tmp_path}/d") if x[0] != ".") == ["README.md", "dataset_info.json", "train.jsonl"]
    assert os.path.isfile(f"{tmp_path}/d/train.jsonl") == one_file
    assert json.load(open(f"{tmp_path}/d/dataset_info.json"))["splits"]["train"]["num_examples"] == 2
    card = open(f"{tmp_path}/d/README.md").read()
    assert card.startswith("---\nlicense: other\ntask_categories:\n  - conversational\n") and "| training records | 2 |" in card and "| log events behind them | 6 |" in card
    assert {json.loads(r.value)["session_id"] for r in spark.read.text(f"{tmp_path}/d/train.jsonl").collect()} == {SID, "b"}


def test_command_line(spark, tmp_path, capsys):
    os.makedirs(f"{tmp_path}/logs")
    with open(f"{tmp_path}/logs/s.jsonl", "w") as f:
        f.writelines(json.dumps(x) + "\n" for x in GARDEN)
    root = ["-w", f"{tmp_path}/logs"]
    assert main(["list", *root]) == 0
    assert json.loads(capsys.readouterr().out)[0]["session_id"] == SID
    assert main(["export", *root, "-f", "jsonl", "-o", f"{tmp_path}/new/out.jsonl"]) == 0
    assert [json.loads(x) for x in open(f"{tmp_path}/new/out.jsonl")] == GARDEN
    assert main(["export", *root, "-s", "nobody"]) == 1 and main(["export", *root, "-f", "huggingface"]) == 2


def test_file_names():
    assert export_filename("markdown", SID) == "hedge-7-é.md" and export_filename("sharegpt", "_x-Y.z") == "_x-Y-z.jsonl"
    assert export_filename("openai", now=datetime(2025, 11, 30, 23, 59, 1)) == "sessions-20251130T235901.jsonl"


def test_markdown_cost_is_added_in_order_and_rounded_as_sql_does(spark):
    """Of these two orders of the same costs, one ends above the tie and one below."""
    costs = {"up": [0.01, 0.01205, 0.0], "exact": [0.03125]}
    lines = [{"type": "user", "sessionId": s, "costUSD": c, "message": {"content": "x"}} for s, own in costs.items() for c in own]
    df = events_of(spark, *lines).repartition(4, F.rand(1))
    shown = {r.session_id: r.line for r in exported(df, S.sessions(df), "markdown").collect()}
    for s, own in costs.items():
        total = 0.0
        for c in own:
            total += c
        assert f"**Cost (est.):** ${total:.4f} " in shown[s]
