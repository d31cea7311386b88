"""Named queries over the given tables, and the same answers as DuckDB SQL from the base columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.exports.write import dataset_numbers, exported, previews
from sessionmill.functions.pricing import estimated_cost
from sessionmill.functions.text import format_cost, format_count, format_latency, how_long_ago, is_live, preview, project_name, short_filename, short_id
from sessionmill.operators import analytics as A
from sessionmill.operators import search as Q
from sessionmill.operators import sessions as S
from sessionmill.operators import sidecar as B
from sessionmill.operators.text_index import index_files, indexed_feed
from sessionmill.plans.adapters import blocks_table, conversations_table, events_table, scratch

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

nano = lambda c: F.round(F.col(c) * 1e9).cast("long")
millis = lambda c: F.unix_millis(F.col(c))

# The event table of adapters.event_lines(), for DuckDB.
EV = """
WITH b AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
), ev AS (
  SELECT 'u' || user_id AS session_id, event_id AS line_index, user_id,
         CASE event_type WHEN 'click' THEN 'user' WHEN 'view' THEN 'assistant' WHEN 'purchase' THEN 'tool_use' WHEN 'error' THEN 'tool_result' WHEN 'signup' THEN 'system' ELSE 'unknown' END AS event_type,
         ts, epoch_us(ts) // 1000 AS ms, k, 'tool' || (k % 12) AS tool,
         CASE WHEN event_id % 7 <> 0 THEN '/work/p' || (user_id % 10) END AS cwd,
         CASE WHEN event_id % 5 = 0 THEN 'b' || (k % 3) END AS git_branch,
         CASE WHEN event_type = 'view' THEN ['opus-large', 'haiku-small', 'sonnet-medium', 'other-model'][CAST(event_id % 4 + 1 AS INTEGER)] END AS model,
         CASE WHEN event_type = 'view' THEN k ELSE 0 END AS i, CASE WHEN event_type = 'view' THEN 2 * k ELSE 0 END AS o,
         CASE WHEN event_type = 'view' THEN k % 5 ELSE 0 END AS r, CASE WHEN event_type = 'view' THEN k % 3 ELSE 0 END AS w,
         CASE WHEN event_id % 3 <> 0 THEN value END AS given
  FROM b
), ec AS (
  SELECT *, coalesce(given, CASE WHEN i + o + r + w > 0 THEN
           CASE WHEN model LIKE '%opus%' THEN i / 1e6 * 15.0 + o / 1e6 * 75.0 + r / 1e6 * 1.5 + w / 1e6 * 18.75
                WHEN model LIKE '%haiku%' THEN i / 1e6 * 1.0 + o / 1e6 * 5.0 + r / 1e6 * 0.1 + w / 1e6 * 1.25
                ELSE i / 1e6 * 3.0 + o / 1e6 * 15.0 + r / 1e6 * 0.3 + w / 1e6 * 3.75 END END, 0.0) AS cost_usd
  FROM ev
), facts AS (
  SELECT session_id, user_id, min(ms) FILTER (WHERE rn = 1) AS first_ms, max(ms) FILTER (WHERE rl = 1) AS last_ms,
         arg_min(cwd, line_index) FILTER (WHERE cwd IS NOT NULL) AS cwd,
         arg_max(git_branch, line_index) FILTER (WHERE git_branch IS NOT NULL) AS git_branch,
         arg_max(model, line_index) FILTER (WHERE model IS NOT NULL) AS model,
         count(*) AS event_count, count(*) FILTER (WHERE event_type = 'user') AS user_count,
         count(*) FILTER (WHERE event_type = 'assistant') AS assistant_count, count(*) FILTER (WHERE event_type = 'system') AS system_count,
         count(*) FILTER (WHERE event_type IN ('tool_use', 'assistant')) AS tool_use_count, count(*) FILTER (WHERE event_type = 'tool_result') AS tool_result_count,
         CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(r) AS BIGINT) AS cache_read_tokens, CAST(sum(w) AS BIGINT) AS cache_creation_tokens,
         sum(cost_usd) AS cost_usd
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_index) AS rn, row_number() OVER (PARTITION BY session_id ORDER BY line_index DESC) AS rl FROM ec)
  GROUP BY session_id, user_id
)
"""

CV = """
WITH cv AS (
  SELECT 'conv-' || conv_id AS session_id, conv_id, turn AS line_index, role AS event_type, text, 1700000000000 + conv_id * 3600000 + turn * 60000 AS ms,
         ['opus-large', 'haiku-small', 'sonnet-medium', 'other-model'][CAST(conv_id % 4 + 1 AS INTEGER)] AS model, CAST(length(text) AS BIGINT) AS i, turn AS o
  FROM conversations
), cc AS (
  SELECT *, CASE WHEN i + o > 0 THEN
       CASE WHEN model LIKE '%opus%' THEN i / 1e6 * 15.0 + o / 1e6 * 75.0 WHEN model LIKE '%haiku%' THEN i / 1e6 * 1.0 + o / 1e6 * 5.0 ELSE i / 1e6 * 3.0 + o / 1e6 * 15.0 END ELSE 0.0 END AS cost_usd
  FROM cv
)
"""

# The preview of a text under a limit of {n}: trimmed, on one line; if over n characters, n bytes and an ellipsis.
PREVIEW = "(CASE WHEN length({t}) <= {n} THEN {t} ELSE left({t}, list_max(list_filter(range(0, {n} + 1), lambda k: strlen(left({t}, k)) <= {n}))) || '…' END)"
FLAT = r"replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), chr(10), ' ')"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


FACTS_SQL = "session_id, first_ms, last_ms, cwd, git_branch, model, event_count, user_count, assistant_count, system_count, tool_use_count, tool_result_count, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens, CAST(round(cost_usd * 1e9) AS BIGINT) AS cost_nanos"
_COUNTS = ("event_count", "user_count", "assistant_count", "system_count", "tool_use_count", "tool_result_count", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")


def flat_facts(facts: DataFrame) -> DataFrame:
    return facts.select("session_id", millis("first_seen").alias("first_ms"), millis("last_seen").alias("last_ms"), "cwd", "git_branch", "model", *_COUNTS, nano("cost_usd").alias("cost_nanos"))


@query("session_stats_events", EV + f"SELECT {FACTS_SQL} FROM facts")
def session_stats_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_facts(S.session_facts(events_table(spark, sf_dir)))


@query(
    "session_stats_conv",
    CV + """SELECT session_id, arg_min(ms, line_index) AS first_ms, arg_max(ms, line_index) AS last_ms, CAST(NULL AS VARCHAR) AS cwd, CAST(NULL AS VARCHAR) AS git_branch, any_value(model) AS model,
       count(*) AS event_count, count(*) FILTER (WHERE event_type = 'user') AS user_count, count(*) FILTER (WHERE event_type = 'assistant') AS assistant_count,
       count(*) FILTER (WHERE event_type = 'system') AS system_count, CAST(0 AS BIGINT) AS tool_use_count, CAST(0 AS BIGINT) AS tool_result_count, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens,
       CAST(0 AS BIGINT) AS cache_read_tokens, CAST(0 AS BIGINT) AS cache_creation_tokens, CAST(round(sum(cost_usd) * 1e9) AS BIGINT) AS cost_nanos FROM cc GROUP BY session_id""",
)
def session_stats_conv(spark, sf_dir):
    return flat_facts(S.session_facts(conversations_table(spark, sf_dir)))


@query(
    "session_first_last",
    EV + """SELECT session_id, arg_min(cwd, line_index) FILTER (WHERE cwd IS NOT NULL) AS cwd, arg_max(git_branch, line_index) FILTER (WHERE git_branch IS NOT NULL) AS git_branch,
       arg_max(model, line_index) FILTER (WHERE model IS NOT NULL) AS model, strftime(arg_max(ts, line_index), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(arg_max(ms, line_index) % 1000 AS VARCHAR), 3, '0') || 'Z' AS last_entry_timestamp FROM ec GROUP BY session_id""",
)
def session_first_last(spark, sf_dir):
    return S.session_facts(events_table(spark, sf_dir)).select("session_id", "cwd", "git_branch", "model", "last_entry_timestamp")


TOOLS = "used AS (SELECT session_id, tool FROM ec WHERE event_type IN ('assistant', 'tool_use'))"


@query("tool_counts", EV + f", {TOOLS} SELECT session_id, tool, count(*) AS n FROM used GROUP BY ALL")
def tool_counts(spark, sf_dir):
    return S.tool_counts(events_table(spark, sf_dir))


@query("tool_maps", EV + f", {TOOLS}, c AS (SELECT session_id, tool, count(*) AS n FROM used GROUP BY ALL), j AS (SELECT session_id, string_agg(tool || '=' || n, ',' ORDER BY tool) AS tools FROM c GROUP BY 1) SELECT facts.session_id, coalesce(tools, '') AS tools FROM facts LEFT JOIN j USING (session_id)")
def tool_maps(spark, sf_dir):
    ordered = F.array_sort(F.map_keys("tool_counts"))
    text = F.array_join(F.transform(ordered, lambda k: F.concat(k, F.lit("="), F.try_element_at(F.col("tool_counts"), k).cast("string"))), ",")
    return S.sessions(events_table(spark, sf_dir)).select("session_id", text.alias("tools"))


@query("top_tools", EV + f", {TOOLS}, t AS (SELECT tool, count(*) AS n FROM used GROUP BY 1 ORDER BY n DESC, tool LIMIT 15) SELECT tool, n, round(100.0 * n / max(n) OVER (), 1) AS bar_pct FROM t")
def top_tools(spark, sf_dir):
    return A.top_tools(S.tool_counts(events_table(spark, sf_dir)))


@query("merged_tool_counts", EV + f", {TOOLS} SELECT tool, count(*) AS n FROM used GROUP BY 1")
def merged_tool_counts(spark, sf_dir):
    return A.merged_tool_counts(S.sessions(events_table(spark, sf_dir)))


TOTALS_SQL = "count(*) AS session_count, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _COUNTS if c != "system_count") + ", CAST(round(sum(cost_usd) * 1e9) AS BIGINT) AS cost_nanos"


@query("global_totals", EV + f"SELECT {TOTALS_SQL} FROM facts")
def global_totals(spark, sf_dir):
    return A.global_totals(S.session_facts(events_table(spark, sf_dir))).withColumn("cost_nanos", nano("cost_usd")).drop("cost_usd")


@query("cache_hit", EV + "SELECT CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, round(100.0 * sum(cache_read_tokens) / (sum(input_tokens) + sum(cache_read_tokens) + sum(cache_creation_tokens)), 1) AS cache_hit_pct FROM facts")
def cache_hit(spark, sf_dir):
    return A.cache_hit(A.global_totals(S.session_facts(events_table(spark, sf_dir)))).select("cache_read_tokens", "cache_hit_pct")


@query("session_totals", EV + f"SELECT {TOTALS_SQL} FROM facts WHERE session_id = 'u7'")
def session_totals(spark, sf_dir):
    return A.global_totals(S.session_facts(events_table(spark, sf_dir)), "u7").withColumn("cost_nanos", nano("cost_usd")).drop("cost_usd")


@query("health", EV + "SELECT count(*) AS session_count, CAST(sum(event_count) AS BIGINT) AS total_events FROM facts")
def health(spark, sf_dir):
    return A.health(S.session_facts(events_table(spark, sf_dir)))


@query("cost_estimate_by_model", CV + "SELECT session_id, line_index, model, CAST(round(cost_usd * 1e9) AS BIGINT) AS cost_nanos FROM cc")
def cost_estimate_by_model(spark, sf_dir):
    rows = conversations_table(spark, sf_dir)
    cost = F.when(F.col("usage").isNotNull(), estimated_cost(F.col("model"), F.col("usage"))).otherwise(0.0)
    return rows.select("session_id", "line_index", "model", F.round(cost * 1e9).cast("long").alias("cost_nanos"))


@query("cost_precedence", EV + "SELECT session_id, line_index, CAST(round(cost_usd * 1e9) AS BIGINT) AS cost_nanos, given IS NULL AS cost_estimated FROM ec")
def cost_precedence(spark, sf_dir):
    return events_table(spark, sf_dir).select("session_id", "line_index", nano("cost_usd").alias("cost_nanos"), "cost_estimated")


@query(
    "summaries",
    CV + f""", s AS (SELECT *, {FLAT.format(c="text")} AS t FROM cv)
    SELECT session_id, line_index, CASE event_type WHEN 'user' THEN CASE WHEN t = '' THEN '👤 User' ELSE '👤 ' || {PREVIEW.format(t="t", n=120)} END
      WHEN 'assistant' THEN CASE WHEN t = '' THEN '🤖 Assistant' ELSE '🤖 ' || {PREVIEW.format(t="t", n=100)} END
      WHEN 'system' THEN '⚙️  System: ' || {PREVIEW.format(t="t", n=100)} ELSE '❓ ' || event_type END AS summary FROM s""",
)
def summaries(spark, sf_dir):
    return conversations_table(spark, sf_dir).select("session_id", "line_index", "summary")


@query(
    "event_summaries",
    EV + """SELECT session_id, line_index, CASE event_type WHEN 'user' THEN '👤 event ' || line_index WHEN 'assistant' THEN '🤖 event ' || line_index || ' · 🔧 ' || tool
       WHEN 'tool_use' THEN '🔧 ' || tool WHEN 'tool_result' THEN '📦 Tool result: t' || line_index ELSE '⚙️  System: ' END AS summary FROM ec""",
)
def event_summaries(spark, sf_dir):
    return events_table(spark, sf_dir).select("session_id", "line_index", "summary")


@query("text_preview", f"WITH s AS (SELECT doc_id, {FLAT.format(c='text')} AS t FROM documents) SELECT doc_id, {PREVIEW.format(t='t', n=100)} AS preview FROM s")
def text_preview(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", preview(F.col("text"), 100).alias("preview"))


LATENCY = """, turns AS (SELECT session_id, line_index, event_type, ms, lag(event_type) OVER s AS before, lag(ms) OVER s AS asked FROM ec WHERE event_type IN ('user', 'assistant') WINDOW s AS (PARTITION BY session_id ORDER BY line_index)),
lat AS (SELECT session_id, line_index, ms - asked AS latency_ms FROM turns WHERE event_type = 'assistant' AND before = 'user')
"""


@query("latency", EV + LATENCY + "SELECT session_id, line_index, latency_ms FROM lat")
def latency(spark, sf_dir):
    return A.latencies(events_table(spark, sf_dir)).select("session_id", F.col("seq.line_index").alias("line_index"), "latency_ms")


@query("latency_percentiles", EV + LATENCY + ", q AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS place, count(*) OVER () AS n FROM lat) SELECT coalesce(max(latency_ms) FILTER (WHERE place = floor(n * 0.5)), 0) AS p50, coalesce(max(latency_ms) FILTER (WHERE place = floor(n * 0.95)), 0) AS p95 FROM q")
def latency_percentiles(spark, sf_dir):
    return A.latency_percentiles(events_table(spark, sf_dir))


@query(
    "sparkline",
    EV + """, c AS (SELECT session_id, least(23, CAST(floor(CAST(ms - first_ms AS DOUBLE) / greatest(last_ms - first_ms, 1) * 24) AS INTEGER)) AS bin FROM ec JOIN facts USING (session_id)),
    n AS (SELECT session_id, bin, count(*) AS n FROM c WHERE bin >= 0 GROUP BY ALL), e AS (SELECT session_id, CAST(unnest(range(24)) AS INTEGER) AS bin FROM facts)
    SELECT session_id, bin, coalesce(n, 0) AS n FROM e LEFT JOIN n USING (session_id, bin)""",
)
def sparkline(spark, sf_dir):
    return A.sparkline(events_table(spark, sf_dir))


NOW = "2024-01-15 12:00:00"


@query("timeline_60m", EV + f", c AS (SELECT 59 - CAST(floor((epoch_ms(TIMESTAMP '{NOW}') - ms) / 60000.0) AS INTEGER) AS bin, count(*) AS n FROM ec WHERE (epoch_ms(TIMESTAMP '{NOW}') - ms) / 60000.0 >= 0 AND (epoch_ms(TIMESTAMP '{NOW}') - ms) / 60000.0 < 60 GROUP BY 1) SELECT CAST(r.range AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(60) r LEFT JOIN c ON c.bin = r.range")
def timeline_60m(spark, sf_dir):
    return A.timeline(events_table(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@query("recent_per_session", EV + "SELECT session_id, line_index FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_index DESC) AS rn FROM ec) WHERE rn <= 20")
def recent_per_session(spark, sf_dir):
    return S.recent_per_session(events_table(spark, sf_dir), 20).select("session_id", "line_index")


# A third of all events in one session, in small blocks: what a hot session does to the operators above.
HOT = EV.replace("SELECT 'u' || user_id AS session_id", "SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 'u' || user_id END AS session_id")
assert HOT != EV


def hot_table(spark, sf_dir):
    events = events_table(spark, sf_dir)
    return events.withColumn("session_id", F.when(F.pmod("line_index", F.lit(3)) == 0, "hot").otherwise(F.col("session_id")))


@query("latency_hot_session", HOT + LATENCY + "SELECT session_id, line_index, latency_ms FROM lat")
def latency_hot_session(spark, sf_dir):
    return A.latencies(hot_table(spark, sf_dir), 1024).select("session_id", F.col("seq.line_index").alias("line_index"), "latency_ms")


@query("recent_hot_session", HOT + "SELECT session_id, line_index FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_index DESC) AS rn FROM ec) WHERE rn <= 3000")
def recent_hot_session(spark, sf_dir):
    return S.recent_per_session(hot_table(spark, sf_dir), 3000, 1024).select("session_id", "line_index")


@query("tail_events", EV + "SELECT session_id, line_index FROM ec ORDER BY ts DESC, line_index DESC LIMIT 500")
def tail_events(spark, sf_dir):
    return S.last_events(events_table(spark, sf_dir), 500).select("session_id", "line_index")


@query("global_ring", EV + "SELECT session_id, line_index FROM ec ORDER BY ts DESC, line_index DESC LIMIT 20000")
def global_ring(spark, sf_dir):
    return S.last_events(events_table(spark, sf_dir)).select("session_id", "line_index")


@query("session_tail", EV + "SELECT session_id, line_index FROM ec WHERE session_id = 'u7' ORDER BY line_index DESC LIMIT 25")
def session_tail(spark, sf_dir):
    return S.session_events(events_table(spark, sf_dir), "u7", 25).select("session_id", "line_index")


TOP = "t AS (SELECT session_id, {c} AS v FROM facts ORDER BY v DESC, session_id LIMIT 10) SELECT session_id, {v} AS value, round(100.0 * v / max(v) OVER (), 1) AS bar_pct FROM t"


@query("top_sessions_cost", EV + ", " + TOP.format(c="cost_usd", v="CAST(round(v * 1e9) AS BIGINT)"))
def top_sessions_cost(spark, sf_dir):
    return A.top_sessions(S.session_facts(events_table(spark, sf_dir)), "cost_usd").select("session_id", nano("cost_usd").alias("value"), "bar_pct")


@query("top_sessions_tokens", EV + ", " + TOP.format(c="output_tokens", v="v"))
def top_sessions_tokens(spark, sf_dir):
    return A.top_sessions(S.session_facts(events_table(spark, sf_dir)), "output_tokens").select("session_id", F.col("output_tokens").alias("value"), "bar_pct")


@query("feed_filter_tool_use", EV + "SELECT session_id, line_index FROM ec WHERE event_type IN ('tool_use', 'assistant')")
def feed_filter_tool_use(spark, sf_dir):
    return Q.feed(events_table(spark, sf_dir), Q.FilterSpec(type="tool_use")).select("session_id", "line_index")


@query("feed_filter_tool_result", EV + "SELECT session_id, line_index FROM ec WHERE event_type = 'tool_result'")
def feed_filter_tool_result(spark, sf_dir):
    return Q.feed(events_table(spark, sf_dir), Q.FilterSpec(type="tool_result")).select("session_id", "line_index")


@query("feed_search_indexed", CV + "SELECT session_id, line_index FROM cv WHERE contains(lower(text), 'and th')")
def feed_search_indexed(spark, sf_dir):
    """The event table stored by session, a trigram index over its files, and a search in those that may hold the text."""
    table, index = (f"{scratch(spark)}/{x}" for x in ("events", "index"))
    events = conversations_table(spark, sf_dir).withColumn("entry", F.to_json("entry"))
    events.repartitionByRange(16, "session_id").write.parquet(table)
    index_files(spark, table, index)
    return indexed_feed(spark, table, index, Q.FilterSpec(search="AND th")).select("session_id", "line_index")


@query("feed_search", CV + "SELECT session_id, line_index FROM cv WHERE contains(lower(text), 'and ')")
def feed_search(spark, sf_dir):
    return Q.feed(conversations_table(spark, sf_dir), Q.FilterSpec(search="AND ")).select("session_id", "line_index")


@query("saved_view", EV + "SELECT session_id, line_index FROM ec WHERE event_type = 'assistant' AND session_id = 'u7' AND tool = 'tool3'")
def saved_view(spark, sf_dir):
    view = Q.FilterSpec.from_json(Q.FilterSpec(type="assistant", session="u7", search='"TOOL3"').to_json())
    return Q.feed(events_table(spark, sf_dir), view).select("session_id", "line_index")


@query("session_search", EV + "SELECT session_id FROM facts WHERE contains(lower(concat_ws(' ', session_id, cwd, git_branch)), '/p3')")
def session_search(spark, sf_dir):
    return Q.search_sessions(S.session_facts(events_table(spark, sf_dir)), "/P3").select("session_id")


@query("palette", EV + "SELECT session_id FROM facts WHERE contains(lower(concat_ws(' ', session_id, cwd)), 'p1') ORDER BY last_ms DESC, session_id LIMIT 60")
def palette(spark, sf_dir):
    return Q.palette(S.session_facts(events_table(spark, sf_dir)), "P1").select("session_id")


@query("feed_rows", EV + "SELECT CASE WHEN length(session_id) <= 14 THEN session_id ELSE left(session_id, 8) || '…' || right(session_id, 4) END AS session, line_index, event_type, CASE WHEN i + o + r + w > 0 THEN (i + r + w) || '↑ ' || o || '↓' END AS tokens, strftime(ts, '%H:%M:%S') AS time FROM ec")
def feed_rows(spark, sf_dir):
    return Q.feed_rows(events_table(spark, sf_dir)).drop("summary", "cost_usd")


@query("event_detail", EV + "SELECT session_id, line_index, model, CASE WHEN event_type = 'assistant' THEN tool ELSE '' END AS tools, CASE WHEN i + o + r + w > 0 THEN o END AS output FROM ec")
def event_detail(spark, sf_dir):
    return Q.event_detail(events_table(spark, sf_dir)).select("session_id", "line_index", "model", F.array_join("tool_uses", ",").alias("tools"), F.col("usage.output").alias("output"))


@query("conversation", CV + "SELECT session_id, line_index, event_type AS role, CAST(1 AS INTEGER) AS parts, text, false AS only_tool_results FROM cv WHERE event_type IN ('user', 'assistant', 'system', 'summary')")
def conversation(spark, sf_dir):
    rows = Q.conversation(conversations_table(spark, sf_dir))
    return rows.select("session_id", F.col("seq.line_index").alias("line_index"), "role", F.size("parts").alias("parts"), F.get("parts", F.lit(0))["text"].alias("text"), "only_tool_results")


# The messages of adapters.block_lines(), for DuckDB: kind, tool id and JSON number of each turn.
BL = """
WITH bl AS (SELECT 'conv-' || conv_id AS session_id, turn AS line_index, role, text, (conv_id + turn) % 6 AS m, 't' || conv_id || '-' || turn AS use, '{"n":' || turn || '}' AS number FROM conversations)
"""


@query("content_parts", BL + """, p AS (
  SELECT *, CASE WHEN m = 0 THEN ['text'] WHEN m = 1 THEN ['text', 'tool_use'] WHEN m = 2 THEN ['tool_result'] WHEN m = 3 THEN ['thinking', 'text'] WHEN m = 4 THEN ['tool_result', 'text'] ELSE ['image', 'other', 'text'] END AS kinds
  FROM bl WHERE role IN ('user', 'assistant', 'system', 'summary')
), e AS (SELECT *, unnest(kinds) AS kind, generate_subscripts(kinds, 1) - 1 AS place FROM p)
SELECT session_id, line_index, CAST(place AS INTEGER) AS place, kind, CASE WHEN kind IN ('text', 'thinking') THEN text END AS text, CASE WHEN kind = 'tool_use' THEN 'look' END AS name,
  CASE WHEN kind IN ('tool_use', 'tool_result') THEN use END AS id, CASE WHEN kind = 'tool_use' OR (kind = 'tool_result' AND m = 4) THEN number WHEN kind = 'tool_result' THEN text END AS body, m = 2 AS only_tool_results
FROM e""")
def content_parts(spark, sf_dir):
    rows = Q.conversation(blocks_table(spark, sf_dir))
    rows = rows.select("session_id", F.col("seq.line_index").alias("line_index"), "only_tool_results", F.posexplode("parts").alias("place", "p"))
    return rows.select("session_id", "line_index", "place", "p.kind", "p.text", "p.name", "p.id", "p.body", "only_tool_results")


@query("export_tool_chat", BL + """, m1 AS (
  SELECT session_id, line_index, 0 AS sub, CASE WHEN m IN (2, 4) THEN 'tool' ELSE 'user' END AS role, CASE WHEN m = 4 THEN number ELSE text END AS content, CASE WHEN m IN (2, 4) THEN use END AS tool_call_id, NULL AS call FROM bl WHERE role = 'user'
  UNION ALL SELECT session_id, line_index, 1, 'user', text, NULL, NULL FROM bl WHERE role = 'user' AND m = 4
  UNION ALL SELECT session_id, line_index, 0, 'assistant', CASE WHEN m <> 2 THEN text END, NULL, CASE WHEN m = 1 THEN use || ' look ' || number END FROM bl WHERE role = 'assistant'
)
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY line_index, sub) - 1 AS INTEGER) AS place, role, content, tool_call_id, call FROM m1""")
def export_tool_chat(spark, sf_dir):
    """Every message of the tool-calling export, tool results and calls included."""
    events = blocks_table(spark, sf_dir)
    message = "struct<role:string,content:string,tool_call_id:string,tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>"
    rows = exported(events, S.sessions(events), "openai", max_events=None).select("session_id", F.from_json("line", f"messages array<{message}>").alias("r"))
    rows = rows.select("session_id", F.posexplode("r.messages").alias("place", "m"))
    call = F.get("m.tool_calls", F.lit(0))
    told = F.when(call.isNotNull(), F.concat_ws(" ", call["id"], call["function"]["name"], call["function"]["arguments"]))
    return rows.select("session_id", "place", "m.role", "m.content", "m.tool_call_id", told.alias("call"))


@query("min_events_filter", EV + "SELECT session_id, event_count FROM facts WHERE event_count >= 70")
def min_events_filter(spark, sf_dir):
    return S.with_min_events(S.session_facts(events_table(spark, sf_dir)), 70).select("session_id", "event_count")


@query("session_in_list", EV + "SELECT session_id, event_count FROM facts WHERE session_id IN ('u1', 'u2', 'u30')")
def session_in_list(spark, sf_dir):
    ids = S.parse_session_list(" u1, u2,,u30 ")
    return S.select_sessions(S.session_facts(events_table(spark, sf_dir)), ids).select("session_id", "event_count")


@query("project_groups", EV + "SELECT coalesce(cwd, '__unknown__') AS cwd, count(*) AS session_count, max(last_ms) AS last_ms, CASE WHEN cwd IS NULL THEN '(unknown project)' ELSE string_split(cwd, '/')[-1] END AS project FROM facts GROUP BY cwd")
def project_groups(spark, sf_dir):
    groups = A.project_groups(S.session_facts(events_table(spark, sf_dir)))
    return groups.select("cwd", "session_count", millis("last_seen").alias("last_ms"), "project")


def _overlapping(rows: DataFrame) -> DataFrame:
    """A snapshot, and a live stream that brings every second event again, later and with another summary."""
    again = rows.where("line_index % 2 = 0").withColumn("observed_at", F.col("observed_at") + F.expr("INTERVAL 1 DAY")).withColumn("summary", F.lit("again"))
    return again.unionByName(rows)


@query("dedup_events", EV + "SELECT session_id, line_index, ms, CASE event_type WHEN 'user' THEN '👤 event ' || line_index WHEN 'assistant' THEN '🤖 event ' || line_index || ' · 🔧 ' || tool WHEN 'tool_use' THEN '🔧 ' || tool WHEN 'tool_result' THEN '📦 Tool result: t' || line_index ELSE '⚙️  System: ' END AS summary FROM ec")
def dedup_events(spark, sf_dir):
    return S.deduplicated(_overlapping(events_table(spark, sf_dir))).select("session_id", "line_index", millis("observed_at").alias("ms"), "summary")


@query("dedup_by_session_line", CV + "SELECT session_id, line_index, ms, true AS first_stays FROM cv")
def dedup_by_session_line(spark, sf_dir):
    rows = S.deduplicated(_overlapping(conversations_table(spark, sf_dir)), key="session")
    return rows.select("session_id", "line_index", millis("observed_at").alias("ms"), (F.col("summary") != "again").alias("first_stays"))


def _sidecar(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Session facts, bookmarks of every fifth user, and tags of every third."""
    facts = S.session_facts(events_table(spark, sf_dir))
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().withColumn("session_id", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    bookmarks = users.where("user_id % 5 = 0").select("session_id")
    tags = users.where("user_id % 3 = 0").select("session_id", "user_id", B.add_tags(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("a"))).alias("tags"))
    return facts, bookmarks, tags


@query("bookmarked_first", EV + "SELECT session_id, user_id % 5 = 0 AS bookmarked, CASE WHEN user_id % 3 = 0 THEN 'a,b' ELSE '' END AS tags, last_ms FROM facts")
def bookmarked_first(spark, sf_dir):
    facts, bookmarks, tags = _sidecar(spark, sf_dir)
    rows = B.bookmarked_first(B.with_sidecar(facts, bookmarks, tags.drop("user_id")))
    return rows.select("session_id", "bookmarked", F.array_join("tags", ",").alias("tags"), millis("last_seen").alias("last_ms"))


@query("bookmarked_only", EV + "SELECT session_id FROM facts WHERE user_id % 5 = 0 AND contains(lower(concat_ws(' ', session_id, cwd, git_branch, CASE WHEN user_id % 3 = 0 THEN 'a b' END)), 'a b')")
def bookmarked_only(spark, sf_dir):
    facts, bookmarks, tags = _sidecar(spark, sf_dir)
    return Q.search_sessions(B.with_sidecar(facts, bookmarks, tags.drop("user_id")), "A B", bookmarked_only=True).select("session_id")


@query("tags_removed", EV + "SELECT session_id, CASE WHEN user_id % 2 = 0 THEN 'b' ELSE 'a,b' END AS tags, user_id % 2 = 1 AS none_left FROM facts WHERE user_id % 3 = 0")
def tags_removed(spark, sf_dir):
    """The tag a is taken from even users; and both tags from odd ones, of which nothing is left."""
    _, _, tags = _sidecar(spark, sf_dir)
    kept = F.when(F.col("user_id") % 2 == 0, B.remove_tag(F.col("tags"), "a")).otherwise(F.col("tags"))
    gone = F.when(F.col("user_id") % 2 == 1, B.remove_tag(B.remove_tag(F.col("tags"), "a"), "b")).otherwise(F.col("tags"))
    return tags.select("session_id", F.array_join(kept, ",").alias("tags"), gone.isNull().alias("none_left"))


@query("bookmarks_toggled", EV + "SELECT session_id FROM facts WHERE (user_id % 5 = 0) <> (user_id % 2 = 0)")
def bookmarks_toggled(spark, sf_dir):
    """Bookmarks after every even user's was turned over."""
    _, bookmarks, _ = _sidecar(spark, sf_dir)
    even = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 2 = 0").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"))
    return B.toggled_rows(bookmarks, even)


@query("dataset_totals", CV + "SELECT count(DISTINCT session_id) AS num_examples, count(*) AS event_count, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(round(sum(cost_usd) * 1e9) AS BIGINT) AS cost_nanos FROM cc")
def dataset_totals(spark, sf_dir):
    totals = dataset_numbers(S.session_facts(conversations_table(spark, sf_dir)))
    return totals.withColumn("cost_nanos", nano("cost_usd")).drop("cost_usd")


@query("export_previews", CV + ", l AS (SELECT conv_id, '# Session ' || session_id || chr(10) || chr(10) || '- **ID:** `' || session_id || '`' || chr(10) AS head FROM cv GROUP BY ALL) SELECT 'conv-' || conv_id AS session_id, left(head, 20) AS preview FROM l")
def export_previews(spark, sf_dir):
    return previews(_export(spark, sf_dir, "markdown"), 20)


@query("scaled_sparkline", EV + """, c AS (SELECT session_id, least(23, CAST(floor(CAST(ms - first_ms AS DOUBLE) / greatest(last_ms - first_ms, 1) * 24) AS INTEGER)) AS bin FROM ec JOIN facts USING (session_id)),
    n AS (SELECT session_id, bin, count(*) AS n FROM c WHERE bin >= 0 GROUP BY ALL), e AS (SELECT session_id, CAST(unnest(range(24)) AS INTEGER) AS bin FROM facts), s AS (SELECT session_id, bin, coalesce(n, 0) AS n FROM e LEFT JOIN n USING (session_id, bin))
    SELECT session_id, bin, n, n / CAST(greatest(max(n) OVER (PARTITION BY session_id), 1) AS DOUBLE) AS height FROM s""")
def scaled_sparkline(spark, sf_dir):
    return A.scaled(A.sparkline(events_table(spark, sf_dir)), partition="session_id")


@query("formatted_counts", EV + "SELECT session_id, format('{:,}', output_tokens * 1000 + event_count) AS tokens FROM facts")
def formatted_counts(spark, sf_dir):
    return S.session_facts(events_table(spark, sf_dir)).select("session_id", format_count(F.col("output_tokens") * 1000 + F.col("event_count")).alias("tokens"))


@query("display_formats", EV + f"""SELECT session_id, printf('$%.4f', cost_usd) AS cost, CASE WHEN cwd IS NULL THEN '(unknown project)' ELSE string_split(cwd, '/')[-1] END AS project, session_id AS file, session_id AS short,
  CASE WHEN s < 5 THEN 'now' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS ago, ago < 10000 AS live FROM (SELECT *, epoch_ms(TIMESTAMP '{NOW}') - last_ms AS ago, CAST(floor((epoch_ms(TIMESTAMP '{NOW}') - last_ms) / 1000.0) AS BIGINT) AS s FROM facts)""")
def display_formats(spark, sf_dir):
    events, now = events_table(spark, sf_dir), F.lit(NOW).cast("timestamp")
    facts = S.with_costs_in_order(S.session_facts(events), events)
    seen, sid = F.col("last_seen"), F.col("session_id")
    return facts.select("session_id", format_cost(F.col("cost_usd")).alias("cost"), project_name(F.col("cwd")).alias("project"), short_filename(sid).alias("file"), short_id(sid).alias("short"), how_long_ago(seen, now).alias("ago"), is_live(seen, now).alias("live"))


@query("latency_badges", EV + LATENCY + "SELECT session_id, line_index, CASE WHEN latency_ms < 1000 THEN latency_ms || 'ms' WHEN latency_ms < 60000 THEN printf('%.1fs', latency_ms / 1000.0) ELSE (latency_ms // 60000) || 'm ' || CAST(round((latency_ms % 60000) / 1000.0) AS BIGINT) || 's' END AS badge FROM lat")
def latency_badges(spark, sf_dir):
    return A.latencies(events_table(spark, sf_dir)).select("session_id", F.col("seq.line_index").alias("line_index"), format_latency(F.col("latency_ms")).alias("badge"))


@query("retained", EV + "SELECT session_id, line_index FROM ec ORDER BY ts DESC, line_index DESC LIMIT 3600")
def retained(spark, sf_dir):
    """What a viewer with room for 4,000 events still holds."""
    return B.retained(events_table(spark, sf_dir), 4000).select("session_id", "line_index")


@query("matched_tool_calls", EV + """SELECT u.session_id, u.line_index, u.tool, min(r.line_index) AS result_line FROM ec u
    LEFT JOIN ec r ON r.session_id = u.session_id AND r.k = u.k AND r.event_type = 'tool_result' WHERE u.event_type = 'assistant' GROUP BY ALL""")
def matched_tool_calls(spark, sf_dir):
    return A.matched_tool_calls(events_table(spark, sf_dir, call="k")).select("session_id", F.col("use_seq.line_index").alias("line_index"), "tool", F.col("result_seq.line_index").alias("result_line"))


def _export(spark, sf_dir: str, fmt: str) -> DataFrame:
    events = conversations_table(spark, sf_dir)
    return exported(events, S.sessions(events), fmt, max_events=None)


def _record_query(fmt: str, list_name: str, role: str, said: str, told: str, where: str, id_name: str = "session_id"):
    """Every message of every record in order, as role and text, with the record's other fields."""
    more = fmt != "sharegpt"
    fields = {"model": "string", "title": "string", "metadata.event_count": "bigint", "metadata.input_tokens": "bigint", "metadata.output_tokens": "bigint", "metadata.user_count": "bigint"} if more else {"metadata.event_count": "bigint"}
    own = {"model": "any_value(model)", "title": "CAST(NULL AS VARCHAR)", "event_count": "count(*)", "input_tokens": "CAST(sum(i) AS BIGINT)", "output_tokens": "CAST(sum(o) AS BIGINT)", "user_count": "count(*) FILTER (WHERE event_type = 'user')"}
    names = [k.rpartition(".")[2] for k in fields]

    @query(
        f"export_{fmt}",
        CV + f""", m AS (SELECT session_id, count(*) AS messages, string_agg({role} || ': ' || text, chr(10) ORDER BY line_index) AS said FROM cv WHERE {where} GROUP BY 1),
        f AS (SELECT session_id, {", ".join(f"{own[n]} AS {n}" for n in names)} FROM cv GROUP BY 1)
        SELECT f.*, coalesce(messages, 0) AS messages, coalesce(said, '') AS said FROM f LEFT JOIN m USING (session_id)""",
    )
    def run(spark, sf_dir):
        record = F.parse_json("line")
        messages = F.variant_get(record, f"$.{list_name}", "array<variant>")
        text = F.transform(messages, lambda x: F.concat(F.variant_get(x, told, "string"), F.lit(": "), F.try_variant_get(x, said, "string")))
        return _export(spark, sf_dir, fmt).select(
            F.variant_get(record, f"$.{id_name}", "string").alias("session_id"),
            F.size(messages).cast("long").alias("messages"),
            F.array_join(text, "\n").alias("said"),
            *(F.variant_get(record, f"$.{k}", kind).alias(n) for (k, kind), n in zip(fields.items(), names, strict=True)),
        )

    return run


_record_query("messages", "messages", "event_type", "$.content[0].text", "$.role", "event_type IN ('user', 'assistant')")
_record_query("openai", "messages", "event_type", "$.content", "$.role", "event_type IN ('user', 'assistant')")
_record_query("sharegpt", "conversations", "CASE event_type WHEN 'user' THEN 'human' ELSE 'gpt' END", "$.value", "$.from", "event_type IN ('user', 'assistant') AND text <> ''", "id")


@query("export_jsonl", CV + "SELECT session_id, event_type, text, i AS input_tokens FROM cv")
def export_jsonl(spark, sf_dir):
    record = F.parse_json("line")
    return _export(spark, sf_dir, "jsonl").select(
        F.variant_get(record, "$.sessionId", "string").alias("session_id"), F.variant_get(record, "$.type", "string").alias("event_type"),
        F.variant_get(record, "$.message.content[0].text", "string").alias("text"), F.variant_get(record, "$.message.usage.input_tokens", "bigint").alias("input_tokens"),
    )


@query(
    "export_markdown",
    CV + """, p AS (SELECT session_id, line_index, CASE event_type WHEN 'user' THEN '## 👤 User' || chr(10) || chr(10) ELSE '## 🤖 Assistant' || chr(10) || chr(10) END || text || chr(10) || chr(10) || chr(10) AS piece FROM cv WHERE event_type IN ('user', 'assistant')),
    t AS (SELECT session_id, string_agg(piece, '' ORDER BY line_index) AS told FROM p GROUP BY 1),
    f AS (SELECT session_id, any_value(model) AS model, count(*) AS n, sum(cost_usd) AS cost, CAST(sum(o) AS BIGINT) AS o FROM cc GROUP BY 1)
    SELECT f.session_id, '# Session ' || f.session_id || chr(10) || chr(10) || '- **ID:** `' || f.session_id || '`' || chr(10) || '- **Model:** ' || model || chr(10) || '- **Events:** ' || n || ' · **Cost (est.):** ' || printf('$%.4f', cost) || ' · **Tokens out:** ' || o || chr(10) || chr(10) || coalesce(told, '') AS line
    FROM f LEFT JOIN t USING (session_id)""",
)
def export_markdown(spark, sf_dir):
    return _export(spark, sf_dir, "markdown")
