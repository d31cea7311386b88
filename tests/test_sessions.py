import random

import pytest
from helpers import events_of
from pyspark.sql import functions as F

from sessionmill.exports.write import dataset_numbers
from sessionmill.functions.text import format_cost, format_count, format_latency
from sessionmill.operators import analytics as A
from sessionmill.operators import search as Q
from sessionmill.operators import sessions as S
from sessionmill.operators import sidecar as B
from sessionmill.plans import api


def entry(kind, session="a", **more):
    return {"type": kind, "sessionId": session, **more}


def said(*names):
    return {"content": [{"type": "tool_use", "name": n} for n in names]}


def test_facts_of_two_sessions(spark):
    """A garden planner in four turns, and a weather question without an answer."""
    counters = lambda i, o: {"model": "haiku-mini", "usage": {"input_tokens": i, "output_tokens": o}}
    garden = [entry("user", "garden"), entry("assistant", "garden", message=counters(700, 31)), entry("system", "garden"), entry("assistant", "garden", message=counters(40, 9))]
    df = events_of(spark, *garden, entry("user", "weather"))
    facts = {r.session_id: r for r in S.sessions(df).collect()}
    g, w = facts["garden"], facts["weather"]
    assert (g.event_count, g.user_count, g.assistant_count, g.input_tokens, g.output_tokens, g.model) == (4, 1, 2, 740, 40, "haiku-mini")
    assert g.cost_usd == pytest.approx((740 * 1.0 + 40 * 5.0) / 1e6)
    assert (w.event_count, w.user_count, w.assistant_count, w.input_tokens, w.cost_usd, w.model) == (1, 1, 0, 0, 0.0, None)
    assert tuple(api.health(df).first()) == (2, 5)


def test_tools_of_a_session(spark):
    plough, sow = said("dig", "rake", "rake", "water"), said("water", "dig", "water")
    df = events_of(spark, entry("assistant", message=plough), entry("tool_use", name="harvest"), entry("assistant", message=sow), entry("tool_result"), entry("tool_use"), entry("tool_result"))
    (a,) = S.sessions(df).collect()
    assert a.tool_counts == {"water": 3, "dig": 2, "rake": 2, "harvest": 1}
    assert (a.tool_use_count, a.tool_result_count) == (9, 2)
    assert [(r.tool, r.n, r.bar_pct) for r in A.top_tools(A.merged_tool_counts(S.sessions(df)), 3).collect()] == [("water", 3, 100.0), ("dig", 2, 66.7), ("rake", 2, 66.7)]


def test_first_and_last_values(spark):
    df = events_of(spark, entry("user", cwd="/1", gitBranch="x", timestamp="2024-01-02T00:00:00Z"), entry("user", cwd="/2", gitBranch="y", timestamp="2024-01-01T00:00:00Z"), entry("ai-title", aiTitle="T"), entry("ai-title", aiTitle=3))
    a = S.sessions(df).first()
    assert (a.cwd, a.git_branch, a.last_entry_timestamp, a.title) == ("/1", "y", "2024-01-01T00:00:00Z", "T")
    assert S.sessions(events_of(spark, entry("user"))).first().tool_counts == {}


def test_rings_and_recency(spark):
    df = events_of(spark, *(entry("user" if i % 3 else "system") for i in range(23)))
    assert {e.line_index for e in S.recent_per_session(df, 9).collect()} == set(range(14, 23))
    assert [e.line_index for e in S.last_events(df, 4).collect()] == [19, 20, 21, 22]
    assert S.session_events(df, "a", 0).count() == 0 and S.session_events(df, "z").count() == 0
    assert [e.line_index for e in S.session_events(df, "a", 2).collect()] == [21, 22]
    three = events_of(spark, entry("user", "dawn"), entry("user", "noon"), entry("user", "dusk"), entry("system", "dawn"))
    assert [r.session_id for r in api.sessions(three).collect()] == ["dawn", "dusk", "noon"]


def test_unknown_sessions(spark):
    df = events_of(spark, entry("user"))
    with pytest.raises(api.UnknownSession):
        api.session(df, "x")
    with pytest.raises(api.UnknownSession):
        api.export(df, [])
    assert api.export(df, None).count() == 1
    assert S.parse_session_list(None) is None and S.parse_session_list(" , ") == []


def loop_latencies(rows):
    asked, out = None, []
    for kind, t in rows:
        if kind == "user":
            asked = t
        elif kind == "assistant" and asked is not None:
            out.append(t - asked)
            asked = None
    return out


def at(ms):
    return f"2024-01-01T00:00:{ms / 1000:06.3f}Z"


def test_latency_is_the_stateful_loop(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice(["user", "assistant", "system", "tool_use"]), rng.randrange(59_000)) for _ in range(200)]
    df = events_of(spark, *(entry(k, timestamp=at(t)) for k, t in rows))
    for block_lines in (1 << 16, 1, 3, 50):  # whatever the cuts
        got = [r.latency_ms for r in A.latencies(df, block_lines).orderBy("seq").collect()]
        assert got == loop_latencies(rows)


@pytest.mark.parametrize("block_lines", [1, 4, 1 << 16])
@pytest.mark.parametrize("n", [1, 5, 30, 1000])
def test_rings_of_blocks(spark, n, block_lines):
    """Sessions over several files and blocks, one of them with half of all events."""
    a = events_of(spark, *(entry("user", "hot" if i % 2 else f"s{i % 5}") for i in range(60)), path="a.jsonl")
    b = events_of(spark, *(entry("user", "hot" if i % 3 else f"s{i % 7}") for i in range(40)), path="b.jsonl", start=3)
    df = a.unionByName(b)
    every = {}
    for r in sorted(df.select("session_id", "seq").collect(), key=lambda r: tuple(r.seq)):
        every.setdefault(r.session_id, []).append(tuple(r.seq))
    got = {}
    for r in S.recent_per_session(df, n, block_lines).collect():
        got.setdefault(r.session_id, []).append(tuple(r.seq))
    assert {k: sorted(v) for k, v in got.items()} == {k: v[-n:] for k, v in every.items()}
    assert S.recent_per_session(df, n, block_lines).columns == df.columns


@pytest.mark.parametrize("values", [[], [7], [1, 2], [4, 1, 3, 2], [5] * 9 + [1], list(range(1000, 0, -1)), [*range(3000), 10**15], [-(10**15)] * 70 + list(range(30))])
def test_percentile_places(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x long").repartition(3)
    s = sorted(values)
    want = tuple(s[int(len(s) * p)] if s else 0 for p in (0.5, 0.95, 0.0))
    for bins in (4096, 2, 7):
        assert tuple(A.percentile_at(df, "x", {"p50": 0.5, "p95": 0.95, "p0": 0.0}, bins).first()) == want
    for kind in ("double", "int") if max(map(abs, values), default=0) < 2**31 else ("double",):
        typed = df.select(F.col("x").cast(kind))
        assert tuple(A.percentile_at(typed, "x", {"p50": 0.5, "p95": 0.95, "p0": 0.0}, 16).first()) == want


def test_percentiles_of_far_apart_and_of_real_numbers(spark):
    wide = [-(2**63), 2**63 - 1, 2**62, 2**62 + 1, 2**62 + 2, 5, 6, -(2**62)]
    df = spark.createDataFrame([(v,) for v in wide], "x long")
    shares = {f"p{i}": i / 8 for i in range(8)}
    assert list(A.percentile_at(df, "x", shares, 4).first()) == sorted(wide)
    real = [0.1 * i * (-1) ** i for i in range(50)] + [1e300, 1e-300, 0.1, 0.1]
    df = spark.createDataFrame([(v,) for v in real] + [(None,)], "x double")
    assert A.percentile_at(df, "x", {"p": 0.3, "q": 0.99}, 8).first() == (sorted(real)[int(54 * 0.3)], sorted(real)[int(54 * 0.99)])


def test_sparkline(spark):
    df = events_of(spark, *(entry("user") for _ in range(25)))
    assert [r.n for r in A.sparkline(df).orderBy("bin").collect()] == [1] * 23 + [2]
    assert [r.n for r in A.sparkline(events_of(spark, entry("user"))).orderBy("bin").collect()] == [1] + [0] * 23


def test_timeline_edges(spark):
    df = spark.createDataFrame([(0,), (1,), (60,), (61,), (3599,), (3600,), (-1,)], "age long").select(F.timestamp_seconds(10_000 - F.col("age")).alias("observed_at"))
    got = {r.bin: r.n for r in A.timeline(df, F.timestamp_seconds(F.lit(10_000))).collect()}
    assert len(got) == 60 and (got[59], got[58], got[0]) == (2, 2, 1) and sum(got.values()) == 5


def test_cache_hit_without_input(spark):
    assert A.cache_hit(A.global_totals(S.session_facts(events_of(spark, entry("user"))))).first().cache_hit_pct == 0.0


def test_feed_and_search(spark):
    df = events_of(spark, entry("assistant", message=said("Read")), entry("tool_use", name="x"), entry("user", content="100% a_b"), entry("tool_result"))
    ids = lambda **v: [r.line_index for r in Q.feed(df, Q.FilterSpec(**v)).collect()]
    assert ids(type="tool_use") == [0, 1] and ids(type="tool_result") == [3] and ids(type="user") == [2] and len(ids()) == 4
    assert ids(search="0% A_B") == [2] and ids(search="%") == [2] and ids(search="READ") == [0] and ids(session="b") == []
    view = Q.FilterSpec("user", "q", "s", "f")
    assert Q.FilterSpec.from_json(view.to_json()) == view


def test_conversation_parts(spark):
    parts = [{"type": "text", "text": "t"}, {"type": "thinking", "thinking": "h"}, {"type": "tool_use", "id": "1", "name": "N", "input": {"a": 1}}, {"type": "tool_result", "tool_use_id": "1", "content": [1]}, {"type": "image"}, {"type": "new"}]
    df = events_of(spark, entry("user", message={"content": parts}), entry("user", message={"content": []}), entry("assistant", message={"content": "plain"}), entry("attachment"))
    rows = Q.conversation(df).orderBy("seq").collect()
    assert [p.kind for p in rows[0].parts] == ["text", "thinking", "tool_use", "tool_result", "image", "other"]
    assert rows[0].parts[3].body == "[1]" and rows[0].parts[2].body == '{"a":1}' and not rows[0].only_tool_results
    assert rows[1].only_tool_results and rows[2].parts[0].text == "plain" and len(rows) == 3


def test_the_first_to_arrive_stays(spark):
    df = events_of(spark, entry("user"), entry("user")).unionByName(events_of(spark, entry("user"), path="b.jsonl"))
    later = df.withColumn("observed_at", F.col("observed_at") + F.expr("INTERVAL 1 HOUR")).withColumn("summary", F.lit("later"))
    both = later.unionByName(df)
    for key, n in (("file", 3), ("session", 2)):
        rows = S.deduplicated(both, key=key).collect()
        assert len(rows) == n and all(r.summary != "later" for r in rows)
    with pytest.raises(ValueError):
        S.deduplicated(df, key="line")


def test_sidecar(spark):
    facts = S.session_facts(events_of(spark, entry("user", "a"), entry("user", "b"), entry("user", "c")))
    rows = B.with_sidecar(facts, B.bookmarks_table(spark, {"a"}), B.tags_table(spark, {"b": ["Hot"], "c": []}))
    assert [r.session_id for r in B.bookmarked_first(rows).collect()] == ["a", "c", "b"]
    assert [r.session_id for r in Q.search_sessions(rows, "hot").collect()] == ["b"]
    assert [r.session_id for r in Q.search_sessions(rows, "", bookmarked_only=True).collect()] == ["a"]
    assert B.toggled({"a"}, "a") == set() and B.toggled(set(), "a") == {"a"}
    tags = spark.range(1).select(B.add_tags(F.array(F.lit("x")), F.array(F.lit("y"), F.lit("x"))).alias("t"), B.remove_tag(F.array(F.lit("x")), "x").alias("none")).first()
    assert tags.t == ["x", "y"] and tags.none is None


def test_matched_tool_calls(spark):
    use = {"content": [{"type": "tool_use", "id": "1", "name": "N"}, {"type": "tool_use", "id": "2", "name": "M"}]}
    df = events_of(spark, entry("assistant", message=use), entry("user", message={"content": [{"type": "tool_result", "tool_use_id": "1"}]}))
    got = {r.tool: r.result_seq and r.result_seq.line_index for r in A.matched_tool_calls(df).collect()}
    assert got == {"N": 1, "M": None}
    top = events_of(spark, entry("assistant", message=use), entry("tool_result", tool_use_id="2"), entry("tool_result", tool_use_id="2"), entry("tool_result", "b", tool_use_id="1"))
    assert {r.tool: r.result_seq and r.result_seq.line_index for r in A.matched_tool_calls(top).collect()} == {"N": None, "M": 1}


def test_bookmarks_turned_over(spark):
    ids = lambda *x: B.bookmarks_table(spark, x)
    assert sorted(r.session_id for r in B.toggled_rows(ids("a", "b"), ids("b", "c")).collect()) == ["a", "c"]


def test_drawing_heights_and_counts(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 4), ("b", 0)], "s string, n long")
    assert sorted((r.s, r.height) for r in A.scaled(rows, partition="s").collect()) == [("a", 0.5), ("a", 1.0), ("b", 0.0)]
    assert sorted(r.height for r in A.scaled(rows).collect()) == [0.0, 0.5, 1.0]
    assert spark.range(1).select(format_count(F.lit(1234567))).first()[0] == "1,234,567"


def test_shown_numbers_round_as_sql_does(spark):
    costs = [0.03125, 0.09375, 2.00005, 0.00015, 1.00025, 1234567.00005, 0.0]
    got = spark.createDataFrame([(c,) for c in costs], "c double").select(format_cost(F.col("c"))).collect()
    assert [r[0] for r in got] == [f"${c:.4f}" for c in costs]


def test_badges_round_as_sql_does(spark):
    times = [1000, 1050, 1150, 1250, 1350, 12_250, 12_750, 59_949, 59_950, 59_999]
    got = spark.createDataFrame([(t,) for t in times], "t long").select(format_latency(F.col("t"))).collect()
    assert [r[0] for r in got] == [f"{t / 1000:.1f}s" for t in times]


@pytest.mark.parametrize("block_lines", [1 << 16, 8])
def test_costs_are_added_in_order_of_arrival(spark, block_lines):
    rng = random.Random(3)
    costs = [rng.choice([1e8, 0.1, 0.3, 0.00005, 1e-9]) for _ in range(40)]
    df = events_of(spark, *({"type": "user", "sessionId": f"s{i % 2}", "costUSD": c} for i, c in enumerate(costs))).repartition(4, F.rand(5))
    got = {r.session_id: r.cost_usd for r in S.with_costs_in_order(S.session_facts(df), df, block_lines).collect()}
    for s in range(2):
        parts = {}
        for i in range(s, len(costs), 2):
            part = i // block_lines if len(costs) // 2 > block_lines else 0
            parts[part] = parts.get(part, 0.0) + costs[i]
        want = 0.0
        for x in parts.values():
            want += x
        assert got[f"s{s}"] == want
    assert S.with_costs_in_order(S.session_facts(df), df).columns == S.session_facts(df).columns


def test_totals_do_not_depend_on_the_order_of_sessions(spark):
    facts = S.session_facts(events_of(spark, *({"type": "user", "sessionId": f"s{i}", "costUSD": 0.1} for i in range(10)))).coalesce(1)
    assert A.global_totals(facts).first().cost_usd == dataset_numbers(facts).first().cost_usd == 1.0
    huge = S.session_facts(events_of(spark, {"sessionId": "a", "costUSD": 1e300}, {"sessionId": "b", "costUSD": 0.5}))
    assert A.global_totals(huge).first().cost_usd == 1e300
    none = huge.where("false")
    assert A.global_totals(none).first().cost_usd == dataset_numbers(none).first().cost_usd == 0.0


@pytest.mark.parametrize("n", [20, 3000])
def test_block_counts_are_not_broadcast(spark, n):
    """Sessions of one event in blocks of one line: as many blocks as events, and nothing of that size goes through the driver."""
    df = events_of(spark, *(entry("user", f"s{i}") for i in range(40)))
    for rows in (S.recent_per_session(df, n, 1), S.with_costs_in_order(S.session_facts(df), df, 1)):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == 40


@pytest.mark.parametrize("n", [20, 3000])
def test_rings_sort_nothing_before_the_shuffle(spark, n):
    """A sort of all that a task reads grows with its part of the table; after the shuffle only what the order needs is sorted."""
    df = events_of(spark, *(entry("user", f"s{i % 4}") for i in range(120)))
    rows = S.recent_per_session(df, n, 16).select("session_id", "line_index")
    plan = rows._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[1]
    events_side = [line for line in plan.splitlines() if line.lstrip().startswith(":")]
    (shuffle,) = [i for i, line in enumerate(events_side) if "Exchange" in line]
    (sort,) = [i for i, line in enumerate(events_side) if "Sort [" in line]
    assert sort < shuffle and "seq" not in events_side[sort]
    want = {(f"s{s}", i) for s in range(4) for i in list(range(s, 120, 4))[-n:]}
    assert {tuple(r) for r in rows.collect()} == want and rows.count() == len(want)
