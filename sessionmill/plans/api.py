"""What a user of the logs asks for, as functions over an event table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.exports.write import exported
from sessionmill.operators import analytics
from sessionmill.operators import sessions as S


@dataclass(frozen=True)
class Snapshot:
    sessions: DataFrame
    events: DataFrame
    total_events: DataFrame


class UnknownSession(ValueError):
    """No session matches."""


def health(events: DataFrame) -> DataFrame:
    return events.agg(F.count_distinct("session_id").alias("session_count"), F.count(F.lit(1)).alias("total_events"))


def sessions(events: DataFrame) -> DataFrame:
    return S.order_sessions(S.sessions(events))


def session(events: DataFrame, session_id: str) -> DataFrame:
    found = S.sessions(events.where(F.col("session_id") == session_id))
    if found.isEmpty():
        raise UnknownSession(session_id)
    return found


def session_events(events: DataFrame, session_id: str, limit: int | None = None) -> DataFrame:
    return S.session_events(events, session_id, limit)


def snapshot(events: DataFrame, n: int = S.SNAPSHOT_EVENTS) -> Snapshot:
    return Snapshot(sessions(events), S.last_events(events, n), events.agg(F.count(F.lit(1)).alias("total_events")))


def export(events: DataFrame, ids: list[str] | None = None, fmt: str = "messages", min_events: int = 1, max_events: int | None = S.SESSION_RING) -> DataFrame:
    """The export rows of some sessions (None: all with at least min_events). No session at all is an error."""
    facts = S.with_min_events(S.select_sessions(S.sessions(events), ids), min_events)
    if facts.isEmpty():
        raise UnknownSession("no session matches")
    return exported(events, facts, fmt, max_events)


def metrics(events: DataFrame, now, session_id: str | None = None) -> dict[str, DataFrame]:
    """Every card of the metrics view. Keep `events` as a stored table: each card reads it."""
    own = events if session_id is None else events.where(F.col("session_id") == session_id)
    facts = S.session_facts(own)
    return {
        "totals": analytics.cache_hit(analytics.global_totals(facts)),
        "tools": analytics.top_tools(S.tool_counts(own)),
        "cost": analytics.top_sessions(facts, "cost_usd"),
        "output": analytics.top_sessions(facts, "output_tokens"),
        "timeline": analytics.timeline(own, now),
        "latency": analytics.latency_percentiles(own),
    }


def register_views(events: DataFrame, events_view: str = "events", sessions_view: str = "sessions") -> None:
    """Open the tables to SQL."""
    events.createOrReplaceTempView(events_view)
    S.sessions(events).createOrReplaceTempView(sessions_view)
