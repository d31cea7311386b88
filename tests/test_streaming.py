import json
import os

from pyspark.sql import functions as F

from sessionmill.operators import analytics as A
from sessionmill.operators import sessions as S
from sessionmill.sources.logs import read_events
from sessionmill.sources.tail import tail_events
from sessionmill.streaming import live, stateful


def grow(root, turns):
    os.makedirs(root, exist_ok=True)
    with open(f"{root}/s.jsonl", "a") as f:
        for kind, second in turns:
            f.write(json.dumps({"type": kind, "timestamp": f"2024-01-01T00:00:{second:02d}Z", "message": {"content": [{"type": "tool_use", "name": "N"}]}}) + "\n")


FIRST = [("user", 1), ("assistant", 3), ("user", 10)]
SECOND = [("user", 11), ("assistant", 15), ("assistant", 16), ("system", 20)]


def run(query, root):
    grow(root, FIRST)
    query.processAllAvailable()
    grow(root, SECOND)
    query.processAllAvailable()
    query.stop()


def test_facts_as_in_batch(spark, tmp_path):
    root = f"{tmp_path}/logs"
    q = live.live_facts(tail_events(spark, root)).writeStream.outputMode("complete").format("memory").queryName("facts").start()
    run(q, root)
    same = ("event_count", "user_count", "assistant_count", "tool_use_count", "last_entry_timestamp", "cost_usd")
    got, want = spark.table("facts").first(), S.session_facts(read_events(spark, root)).first()
    assert [got[c] for c in same] == [want[c] for c in same] and got.event_count == 7


def test_tools_and_rate(spark, tmp_path):
    root = f"{tmp_path}/logs"
    q = live.live_tool_counts(tail_events(spark, root)).writeStream.outputMode("complete").format("memory").queryName("tools").start()
    run(q, root)
    assert [tuple(r) for r in spark.table("tools").collect()] == [("s", "N", 7)]


def test_publish_reaches_all_and_table_restarts(spark, tmp_path):
    root, counts = f"{tmp_path}/logs", {"a": 0, "b": 0}

    def add(name):
        def f(batch, number):
            counts[name] += batch.count()

        return f

    q = live.publish(stateful.live_deduplicated(tail_events(spark, root)), {n: add(n) for n in counts}, f"{tmp_path}/cp1")
    run(q, root)
    assert counts == {"a": 7, "b": 7}
    for _ in range(2):  # the second start goes on from the first one's checkpoint
        q = live.to_table(tail_events(spark, root), f"{tmp_path}/table", f"{tmp_path}/cp2")
        q.processAllAvailable()
        q.stop()
    table = spark.read.parquet(f"{tmp_path}/table")
    assert table.count() == 7 and table.where(F.col("entry").contains("tool_use")).count() == 7


def test_snapshot_then_live_events_once_each(spark, tmp_path):
    root, got = f"{tmp_path}/logs", []
    grow(root, FIRST)
    q = live.follow(spark, root, lambda rows: got.append([(r.line_index, r.event_type) for r in rows.orderBy("line_index").collect()]), f"{tmp_path}/cp", n=2)
    assert [x for x in got if x] == [[(1, "assistant"), (2, "user")]]
    grow(root, SECOND)
    q.processAllAvailable()
    q.stop()
    assert sorted(x for part in got[1:] for x in part) == [(3, "user"), (4, "assistant"), (5, "assistant"), (6, "system")]


def test_a_batch_leaves_out_what_the_snapshot_held(spark, tmp_path, monkeypatch):
    """The snapshot is read late here: what arrived after the stream began is in both, and given out once."""
    root, got = f"{tmp_path}/logs", []
    grow(root, FIRST)
    read = live.read_events

    def late(*args, **more):
        grow(root, SECOND)
        monkeypatch.setattr(live, "read_events", read)
        return read(*args, **more)

    monkeypatch.setattr(live, "read_events", late)
    q = live.follow(spark, root, lambda rows: got.append([r.line_index for r in rows.collect()]), f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert sorted(x for part in got for x in part) == list(range(7))


def test_rate_by_minute(spark, tmp_path):
    root = f"{tmp_path}/logs"
    grow(root, FIRST)
    q = live.live_rate(tail_events(spark, root)).writeStream.outputMode("complete").format("memory").queryName("rate").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("rate").collect()
    assert sum(r.n for r in rows) == 3 and all((r.window.end - r.window.start).total_seconds() == 60 for r in rows)


def test_feed_command(spark, tmp_path, capfd):
    from sessionmill.__main__ import main

    root = f"{tmp_path}/logs"
    grow(root, FIRST)
    assert main(["stream", "-w", root, "--feed", "--seconds", "1"]) == 0
    out = [json.loads(x) for x in capfd.readouterr().out.splitlines() if x.startswith("{")]
    assert [x["line_index"] for x in out] == [0, 1, 2]
