"""One file, written by many tasks, has the bytes that the driver's stream of whole records has."""

import os
import random

import pytest
from helpers import events_of

from sessionmill.exports import fragments as G
from sessionmill.exports.write import exported, stream_text, write_file
from sessionmill.operators import sessions as S


def entries(n=240, seed=1):
    """A third of all events is of one session; others are short, and some have no messages at all."""
    rng = random.Random(seed)
    texts = ['say "messages":[] twice', '"conversations":[]', "plain", "", "é\n\ttwo lines", "\\"]
    for i in range(n):
        sid = "hot" if i % 3 == 0 else f's"{rng.randrange(30)}'
        kind = rng.choice(["user", "assistant", "user", "assistant", "system", "summary"])
        body = [{"type": "text", "text": rng.choice(texts)}, {"type": "tool_use", "id": f"c{i}", "name": 'na"me', "input": {"a": [1, None]}}, {"type": "tool_result", "tool_use_id": f"c{i}", "content": rng.choice(texts)}]
        content = rng.choice([rng.choice(texts), rng.sample(body, rng.randrange(0, 4)), None])
        entry = {"type": kind, "sessionId": sid, "cwd": rng.choice(texts), "message": {"content": content, "model": rng.choice(["opus-x", None])}}
        yield entry | ({"summary": rng.choice(texts)} if kind == "summary" else {}) | ({"timestamp": "2025-01-01T00:00:00Z"} if i % 4 == 0 else {})


@pytest.fixture(scope="module")
def table(spark):
    events = events_of(spark, *entries()).repartition(7).persist()
    yield events, S.sessions(events).persist()


@pytest.mark.parametrize("keep", [None, 3])
@pytest.mark.parametrize("fmt", ["messages", "openai", "sharegpt", "jsonl", "markdown", "huggingface"])
def test_bytes_as_streamed(spark, table, tmp_path, monkeypatch, fmt, keep):
    events, facts = table
    monkeypatch.setattr(G, "HOT_EVENTS", 10 if keep is None else 10**9)
    facts = facts.where("session_id != 's\"7'")
    want = "".join(stream_text(exported(events, facts, fmt, keep), fmt)).encode()
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        size = G.write_export(events, facts, fmt, f"{tmp_path}/new/out", keep)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert os.listdir(f"{tmp_path}/new") == ["out"]
    with open(f"{tmp_path}/new/out", "rb") as f:
        got = f.read()
    assert got == want and size == len(want) and len(want) > 1000


@pytest.mark.parametrize("fmt", ["messages", "markdown"])
def test_rows_of_an_export_as_one_file(table, tmp_path, fmt):
    rows = exported(*table, fmt)
    write_file(rows, fmt, f"{tmp_path}/out")
    with open(f"{tmp_path}/out", encoding="utf-8", newline="") as f:
        assert f.read() == "".join(stream_text(rows, fmt))


def test_a_hot_session_is_written_by_many_tasks(spark, tmp_path):
    """No task holds more than a few times its share of one session that is all of the table."""
    hot = events_of(spark, *({"type": "user", "sessionId": "hot", "message": {"content": f"{i} " * 50}} for i in range(3000)))
    rows = G.fragments(hot, S.sessions(hot), "messages", None)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sizes = [r["count"] for r in rows.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(sizes) == 3002 and len(sizes) == 4 and max(sizes) < 2000


def test_nothing_to_write(spark, table, tmp_path):
    events, facts = table
    for fmt in ("messages", "markdown"):
        assert G.write_export(events, facts.where("false"), fmt, f"{tmp_path}/{fmt}") == 0
        assert os.path.getsize(f"{tmp_path}/{fmt}") == 0
