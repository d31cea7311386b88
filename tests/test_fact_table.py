"""The live fact table, and leaderboards from it, against the batch queries over the same log."""

import json
import os
import random

import pytest
from helpers import plain
from pyspark.sql import functions as F

from sessionmill.operators import analytics as A
from sessionmill.operators import sessions as S
from sessionmill.sources.logs import read_events
from sessionmill.sources.tail import tail_events
from sessionmill.streaming import fact_table as T


def grow(root, rng, n):
    os.makedirs(root, exist_ok=True)
    for _ in range(n):
        entry = {"type": rng.choice(["user", "assistant", "system", "tool_use"]), "sessionId": f"s{rng.randrange(5)}", "name": "tool", "costUSD": rng.randrange(100) / 64}
        entry |= {k: rng.choice(["a", "b", "c"]) for k in ("cwd", "gitBranch", "version") if rng.random() < 0.3}
        entry |= {"message": {"model": rng.choice(["opus", "haiku"]), "usage": {"input_tokens": rng.randrange(50), "output_tokens": 3}}}
        with open(f"{root}/{rng.choice('xyz')}.jsonl", "a") as f:
            f.write(json.dumps(entry) + "\n")


def told(facts):
    return plain(tuple(r) for r in facts.drop("first_seen", "last_seen").collect())


@pytest.mark.parametrize("every", [1, 3, 1000])
def test_as_in_batch_after_restarts(spark, tmp_path, monkeypatch, every):
    monkeypatch.setattr(T, "MERGE_EVERY", every)
    root, path, rng = f"{tmp_path}/logs", f"{tmp_path}/facts", random.Random(every)
    table = T.FactTable(spark, path)
    assert table.facts().count() == 0 and table.facts().columns == list(S.FACT_COLUMNS)
    for n in (7, 30):
        grow(root, rng, n)
        q = T.keep_facts(tail_events(spark, root, max_bytes=600, ledger=f"{tmp_path}/ledger"), path, f"{tmp_path}/cp")
        q.processAllAvailable()
        q.stop()
        want = S.session_facts(read_events(spark, root, index="nonempty"))
        assert told(table.facts().select(*S.FACT_COLUMNS)) == told(want.select(*S.FACT_COLUMNS))
        same = lambda f: plain(tuple(r) for r in A.top_sessions(f, "cost_usd", 3).select("session_id", "cost_usd", "bar_pct").collect())
        assert same(table.facts()) == same(want)
        assert plain(tuple(r) for r in A.global_totals(table.facts()).collect()) == plain(tuple(r) for r in A.global_totals(want).collect())
    bases = [n for n in os.listdir(path) if n.startswith("base-")]
    assert len(bases) <= 2 and bool(bases) == (every < 1000)


def test_a_batch_that_comes_again_counts_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "MERGE_EVERY", 2)
    grow(f"{tmp_path}/logs", random.Random(5), 20)
    events = read_events(spark, f"{tmp_path}/logs").persist()
    table = T.FactTable(spark, f"{tmp_path}/facts")
    parts = [events.where(F.pmod(F.xxhash64("seq"), F.lit(4)) == i) for i in range(4)]
    for number in (0, 0, 1, 1, 2, 2, 3, 3):
        table.add(parts[number], number)
    assert told(table.facts()) == told(S.session_facts(events).select(*S.FACT_COLUMNS))
    os.remove(f"{tmp_path}/facts/base-000000000003/_SUCCESS")  # a merge that did not end: the base before it and its batches still hold all
    assert told(table.facts()) == told(S.session_facts(events).select(*S.FACT_COLUMNS))
