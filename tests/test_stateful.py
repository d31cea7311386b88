"""Keyed state: rings, latency, liveness, and every line once."""

import json
import os
import random
from collections import Counter

import pandas as pd
import pytest
from test_streaming import FIRST, SECOND, grow

from sessionmill.operators import analytics as A
from sessionmill.sources.logs import read_events
from sessionmill.sources.tail import tail_events
from sessionmill.streaming import live, stateful


class Fake:
    """State and timers of one key, with a clock that the test turns."""

    def __init__(self):
        self.values, self.timers, self.now, self.writes = {}, set(), 0, []

    def _cell(self, name):
        fake = self

        class Cell:
            exists = lambda _: name in fake.values
            get = lambda _: fake.values[name]
            clear = lambda _: fake.values.pop(name, None)

            def update(_, value):
                fake.values[name] = value

            def updateValue(_, key, value):
                fake.writes.append(key[0])
                fake.values.setdefault(name, {})[key[0]] = value

        return Cell()

    def getValueState(self, name, *shapes):
        return self._cell(name)

    getMapState = getValueState

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def due(self, processor, key):
        """Turn the clock's timers that are over."""
        out = []
        for ms in sorted(t for t in self.timers if t <= self.now):
            self.timers.remove(ms)
            info = type("Info", (), {"getExpiryTimeInMs": lambda _, ms=ms: ms})()
            out += [x for part in processor.handleExpiredTimer(key, self, info) for x in part.itertuples(index=False)]
        return out


def begun(processor):
    fake = Fake()
    processor.init(fake)
    return fake


def given(processor, fake, key, **columns):
    return [tuple(r) for part in processor.handleInputRows((key,), iter([pd.DataFrame(columns)]), fake) for r in part.itertuples(index=False)]


def test_a_ring_writes_only_new_lines():
    ring = stateful.Ring(5)
    fake, all_lines = begun(ring), []
    rng = random.Random(1)
    for _ in range(30):
        n = rng.randrange(1, 9)
        new = [(len(all_lines) + i, f"line {len(all_lines) + i}") for i in range(n)]
        all_lines += new
        fake.writes.clear()
        shuffled = rng.sample(new, n)
        out = given(ring, fake, "s", source_path=["p"] * n, line_index=[i for i, _ in shuffled], line=[x for _, x in shuffled])
        assert len(fake.writes) == len(out) == min(n, 5)
        assert [r[4] for r in out] == [x for _, x in new[-5:]]
        assert sorted(v[0] for v in fake.values["ring"].values()) == [i for i, _ in all_lines[-5:]]
    assert fake.values["count"] == (len(all_lines),)


def test_a_session_turns_idle_by_the_clock():
    status = stateful.Liveness(10_000)
    fake = begun(status)
    told = lambda rows: [(r[0], r[1], int(r[2].timestamp() * 1000)) for r in rows]
    fake.now = 100_000
    assert told(given(status, fake, "s", ms=[50_000])) == []  # read late: not running now
    assert told(given(status, fake, "s", ms=[95_000, 99_000])) == [("s", True, 100_000)]
    fake.now = 108_000
    assert fake.due(status, ("s",)) == []
    assert told(given(status, fake, "s", ms=[107_000])) == []  # still running
    fake.now = 112_000
    assert fake.due(status, ("s",)) == []
    fake.now = 130_000
    assert told(fake.due(status, ("s",))) == [("s", False, 117_000)]
    assert not fake.values and not fake.timers
    assert told(given(status, fake, "s", ms=[129_000])) == [("s", True, 130_000)]


def test_a_rolling_view_decays_without_events():
    minute = 60_000
    view, told = stateful.Minutes(60), []
    first = begun(view)
    first.now = 1000 * minute + 5
    told += [r for part in view.handleInputRows((1000, 0), iter([pd.DataFrame({"x": [1, 1, 1]})]), first) for r in part.itertuples(index=False)]
    told += [r for part in view.handleInputRows((1000, 0), iter([pd.DataFrame({"x": [1]})]), first) for r in part.itertuples(index=False)]
    assert [r.n for r in told] == [3, 4] and first.timers == {1060 * minute}
    first.now = 1059 * minute
    assert first.due(view, (1000, 0)) == []
    first.now = 1060 * minute
    assert [r.n for r in first.due(view, (1000, 0))] == [0] and not first.values
    assert list(view.handleInputRows((1000, 0), iter([pd.DataFrame({"x": [1]})]), first)) == []  # read late: out of view


def test_minutes_of_a_log(spark, started, tmp_path):
    """A query with timers never runs out of batches, so the table is looked at until it has all."""
    import time

    root, total, rows = f"{tmp_path}/logs", 0, []
    grow(root, FIRST)
    grow(root, SECOND)
    q = started(stateful.live_minutes(tail_events(spark, root)), "minutes")
    end = time.time() + 60
    while time.time() < end and total < 7:
        time.sleep(0.5)
        if q.recentProgress:
            rows = stateful.minutes_now(spark.read.schema(stateful.Minutes.SHAPE).parquet(f"{tmp_path}/minutes")).collect()
            total = sum(r.n for r in rows)
    assert total == 7 and len(rows) <= 2


def test_stretches_of_numbers():
    rng = random.Random(2)
    for _ in range(200):
        seen, cuts = set(), []
        for _ in range(10):
            new = sorted({rng.randrange(30) for _ in range(rng.randrange(6))} - seen)
            cuts, seen = stateful.merged(cuts, new), seen | set(new)
            assert cuts == sorted(set(cuts)) and {n for a, b in zip(cuts[::2], cuts[1::2], strict=True) for n in range(a, b)} == seen
            assert all(stateful.covered(cuts, n) == (n in seen) for n in range(32))


def test_a_repeat_after_any_delay_is_dropped():
    once = stateful.Once()
    fake, got = begun(once), []
    rows = lambda *n: dict(source_path=["p"] * len(n), fallback_id=["s"] * len(n), line_index=list(n), raw=[str(x) for x in n], observed_at=[pd.Timestamp(0)] * len(n))
    for batch in ([0, 1, 2], [2, 3, 3], [9], *([[i] for i in range(10, 40)]), [0, 4, 9, 5], [8, 7, 6]):
        got += [r[2] for r in given(once, fake, "p", **rows(*batch))]
    assert sorted(got) == list(range(40)) and fake.values["held"] == ([0, 40],)


@pytest.fixture
def started(spark, tmp_path):
    """Start a stream into a Parquet table; stop it at the end."""
    running = []

    def start(rows, name):
        q = rows.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/cp_{name}").start()
        running.append(q)
        return q

    yield start
    for q in running:
        q.stop()


def test_state_survives_a_restart(spark, started, tmp_path):
    root = f"{tmp_path}/logs"
    for turns in (FIRST, SECOND):  # the second query goes on from the checkpoint of the first
        grow(root, turns)
        for q in (started(stateful.live_rings(tail_events(spark, root), 2), "rings"), started(stateful.live_latencies(tail_events(spark, root)), "latency")):
            q.processAllAvailable()
            q.stop()
    want = [(r.seq.line_index, r.latency_ms) for r in A.latencies(read_events(spark, root)).orderBy("seq").collect()]
    assert sorted((r.line_index, r.latency_ms) for r in spark.read.parquet(f"{tmp_path}/latency").collect()) == want == [(1, 2000), (4, 4000)]
    written = spark.read.parquet(f"{tmp_path}/rings")
    assert written.count() == 4  # two lines of each batch, not the whole log
    for ring in (stateful.ring_of(written, 2), stateful.rings_in_state(spark, f"{tmp_path}/cp_rings")):
        assert [(r.place, r.line_index, json.loads(r.line)["type"]) for r in ring.orderBy("place").collect()] == [(5, 5, "assistant"), (6, 6, "system")]


def test_status_by_timers(spark, started, tmp_path):
    import time

    root = f"{tmp_path}/logs"
    grow(root, FIRST)
    q = started(stateful.live_status(tail_events(spark, root), 3000), "status")
    end = time.time() + 60
    while time.time() < end and len(rows := spark.read.schema("session_id string, live boolean, at timestamp").parquet(f"{tmp_path}/status").collect() if q.recentProgress else []) < 2:
        time.sleep(0.5)
    assert Counter((r.session_id, r.live) for r in rows) == {("s", True): 1, ("s", False): 1}


def test_tool_calls_meet_their_results_or_a_deadline(spark, tmp_path):
    """As in batch, with an answer before the deadline, one never given, and one in an earlier batch than its use."""
    from sessionmill.functions.events import enriched

    def entry(kind, **more):
        return json.dumps({"type": kind, "message": {"content": [more]}})

    use = lambda i: entry("assistant", type="tool_use", id=i, name="N")
    result = lambda i: entry("user", type="tool_result", tool_use_id=i)
    parts = [[(0, use("a")), (1, use("b")), (2, result("d"))], [(60, result("a")), (61, result("a")), (62, use("d"))], [(4000, use("c"))], [(8000, use("e"))], [(8001, use("f"))]]
    shape, n = "source_path string, fallback_id string, line_index long, raw string, s long", 0
    os.makedirs(f"{tmp_path}/in")
    rows = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    events = enriched(rows.selectExpr("source_path", "fallback_id", "line_index", "raw", "timestamp_seconds(1700000000 + s) as observed_at"))
    q = live.live_matched_tool_calls(events).writeStream.format("memory").queryName("calls").option("checkpointLocation", f"{tmp_path}/cp").start()
    every = []
    for part in parts:
        lines = [{"source_path": "p", "fallback_id": "s", "line_index": n + i, "raw": raw, "s": s} for i, (s, raw) in enumerate(part)]
        n, every = n + len(part), every + lines
        with open(f"{tmp_path}/in/{n}.json", "w") as f:
            f.write("\n".join(map(json.dumps, lines)))
        q.processAllAvailable()
    q.stop()
    batch = enriched(spark.createDataFrame([tuple(x.values()) for x in every], shape).selectExpr("source_path", "fallback_id", "line_index", "raw", "timestamp_seconds(1700000000 + s) as observed_at"))
    want = {r.tool_use_id: r.result_seq and r.result_seq.line_index for r in A.matched_tool_calls(batch).collect()}
    got = {r.tool_use_id: r.result_line for r in spark.table("calls").collect()}
    assert got == {k: want[k] for k in "abcd"} == {"a": 3, "b": None, "c": None, "d": 2}


def test_subscribers_have_places_of_their_own(spark, tmp_path):
    root, table, got = f"{tmp_path}/logs", f"{tmp_path}/table", {"a": [], "b": []}

    def fill(turns):
        grow(root, turns)
        q = live.to_table(tail_events(spark, root), table, f"{tmp_path}/cp")
        q.processAllAvailable()
        q.stop()

    def read(name, checkpoint=None):
        q = live.subscribe(spark, table, lambda rows, _: got[name].extend(r.line_index for r in rows.collect()), checkpoint or f"{tmp_path}/cp_{name}")
        q.processAllAvailable()
        q.stop()

    fill(FIRST)
    read("a")
    fill(SECOND)
    read("b")
    assert (sorted(got["a"]), sorted(got["b"])) == ([0, 1, 2], list(range(7)))
    read("a")  # catches up
    assert sorted(got["a"]) == list(range(7))
    read("a", f"{tmp_path}/cp_again")  # replay
    assert Counter(got["a"]) == dict.fromkeys(range(7), 2)
