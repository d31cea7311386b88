"""Live operators with keyed state of their own: rings, latency, liveness, a rolling hour, and every line once.

State is in RocksDB, one entry for each line of a ring, so an update writes what is new and reads no more than it needs. It survives
restarts with the query's checkpoint, and the ring can be read back from there as a table.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from sessionmill.functions.events import enriched
from sessionmill.operators.analytics import TIMELINE_MINUTES
from sessionmill.operators.sessions import SESSION_RING

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PLACE = ["source_path", "line_index"]
#: How long a session counts as running after its last event.
LIVE_MS = 10_000


def keyed(rows: DataFrame, key: str | list[str], processor: StatefulProcessor, shape: str, time_mode: str = "None") -> DataFrame:
    """Run a processor for each key. Its kind of state needs RocksDB, which is set for queries that the session starts from here on."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy(*([key] if isinstance(key, str) else key)).transformWithStateInPandas(processor, shape, "Append", time_mode)


def in_order(parts: Iterable[pd.DataFrame]) -> pd.DataFrame:
    """The rows of one key and batch by order of arrival."""
    return pd.concat(list(parts), ignore_index=True).sort_values(PLACE, kind="stable", ignore_index=True)


class Ring(StatefulProcessor):
    """The last `size` lines of a key: a count, and a slot for each line. A new line takes the slot of the one it drives out."""

    SHAPE = "session_id string, place long, source_path string, line_index long, line string"

    def __init__(self, size: int):
        self.size = size

    def init(self, handle) -> None:
        self.count = handle.getValueState("count", "n long")
        self.slots = handle.getMapState("ring", "slot long", "place long, source_path string, line_index long, line string")

    def handleInputRows(self, key, rows, timerValues):
        new = in_order(rows)
        first = self.count.get()[0] if self.count.exists() else 0
        new.insert(0, "place", range(first, first + len(new)))
        kept = new.tail(self.size)[["place", *PLACE, "line"]]  # the others would be driven out at once
        for place, path, index, line in kept.itertuples(index=False):
            self.slots.updateValue((int(place) % self.size,), (int(place), path, int(index), line))
        self.count.update((first + len(new),))
        yield kept.assign(session_id=key[0])[["session_id", "place", *PLACE, "line"]]

    def close(self) -> None:
        pass


def live_rings(events: DataFrame, n: int = SESSION_RING) -> DataFrame:
    """Each new line of a session's ring, as JSON, with its place among all lines of the session (append mode). The lines of the last
    `n` places are the ring: ring_of() takes them from a table of these rows, rings_in_state() from a query's checkpoint."""
    rows = events.select("session_id", *PLACE, F.to_json("entry").alias("line"))
    return keyed(rows, "session_id", Ring(n), Ring.SHAPE)


def ring_of(lines: DataFrame, n: int = SESSION_RING) -> DataFrame:
    """The rings after all lines of a table of live_rings(); rows written twice count once."""
    last = lines.groupBy("session_id").agg(F.max("place").alias("last"))
    return lines.join(last, "session_id").where(F.col("place") > F.col("last") - n).drop("last").dropDuplicates(["session_id", "place"])


def rings_in_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The rings that a query of live_rings() holds, read from its checkpoint."""
    held = spark.read.format("statestore").option("stateVarName", "ring").load(checkpoint)
    return held.select(F.col("key.session_id").alias("session_id"), "user_map_value.place", "user_map_value.source_path", "user_map_value.line_index", "user_map_value.line")


class Answers(StatefulProcessor):
    """From a user's event to the next assistant's: one number is kept, the time of the open question."""

    SHAPE = "session_id string, source_path string, line_index long, latency_ms long"

    def init(self, handle) -> None:
        self.asked = handle.getValueState("asked", "ms long")

    def handleInputRows(self, key, rows, timerValues):
        asked = self.asked.get()[0] if self.asked.exists() else None
        out = []
        for row in in_order(rows).itertuples(index=False):
            if row.event_type == "user":
                asked = None if pd.isna(row.ms) else int(row.ms)
            elif asked is not None and not pd.isna(row.ms):
                out.append((key[0], row.source_path, int(row.line_index), int(row.ms) - asked))
                asked = None
            else:
                asked = None
        if asked is None:
            self.asked.clear()
        else:
            self.asked.update((asked,))
        yield pd.DataFrame(out, columns=["session_id", *PLACE, "latency_ms"])

    def close(self) -> None:
        pass


def live_latencies(events: DataFrame) -> DataFrame:
    """Latency of each answer as it arrives."""
    turns = events.where(F.col("event_type").isin("user", "assistant"))
    return keyed(turns.select("session_id", *PLACE, "event_type", F.unix_millis("event_ts").alias("ms")), "session_id", Answers(), Answers.SHAPE)


class Once(StatefulProcessor):
    """Lines of a file whose number was not there before. Kept is a list of stretches of numbers: one, as long as lines come in order."""

    COLUMNS = ["source_path", "fallback_id", "line_index", "raw", "observed_at"]
    SHAPE = "source_path string, fallback_id string, line_index long, raw string, observed_at timestamp"

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "cuts array<bigint>")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows), ignore_index=True).sort_values(["line_index", "observed_at"], kind="stable").drop_duplicates("line_index")
        cuts = [int(x) for x in self.held.get()[0]] if self.held.exists() else []
        fresh = new[[not covered(cuts, int(n)) for n in new["line_index"]]]
        if len(fresh):
            self.held.update((merged(cuts, [int(n) for n in fresh["line_index"]]),))
        yield fresh[self.COLUMNS]

    def close(self) -> None:
        pass


def covered(cuts: list[int], n: int) -> bool:
    """cuts: first number, and number after the last, of each stretch in turn."""
    from bisect import bisect_right

    return bisect_right(cuts, n) % 2 == 1


def merged(cuts: list[int], numbers: list[int]) -> list[int]:
    """The stretches with further numbers, which are in order and outside them."""
    spans = sorted([*zip(cuts[::2], cuts[1::2], strict=True), *((n, n + 1) for n in numbers)])
    out: list[int] = []
    for a, b in spans:
        if out and out[-1] == a:
            out[-1] = b
        else:
            out += [a, b]
    return out


def lines_once(lines: DataFrame) -> DataFrame:
    """Each line of a stream of raw lines once, by file and number, however late it comes again. State: one row for each file."""
    return keyed(lines.select(*Once.COLUMNS), "source_path", Once(), Once.SHAPE)


def live_deduplicated(events: DataFrame) -> DataFrame:
    """Each event of a stream once, by file and line, however late it comes again."""
    lines = events.select("source_path", F.col("session_id").alias("fallback_id"), "line_index", F.to_json("entry").alias("raw"), "observed_at")
    return enriched(lines_once(lines))


class Liveness(StatefulProcessor):
    """Whether a session is running: since an event that is not older than `span`, until a timer finds none that is newer."""

    SHAPE = "session_id string, live boolean, at timestamp"

    def __init__(self, span: int = LIVE_MS):
        self.span = span

    def init(self, handle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        until = max(int(part["ms"].max()) for part in rows) + self.span
        before = self.until.get()[0] if self.until.exists() else None
        if until <= now or (before is not None and until <= before):
            return
        if before is not None:
            self.handle.deleteTimer(before)
        self.until.update((until,))
        self.handle.registerTimer(until)
        if before is None:
            yield self._told(key, True, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.until.clear()
        yield self._told(key, False, expiredTimerInfo.getExpiryTimeInMs())

    def _told(self, key, live: bool, ms: int) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [key[0]], "live": [live], "at": [pd.Timestamp(ms, unit="ms", tz="UTC")]})

    def close(self) -> None:
        pass


def live_status(events: DataFrame, span_ms: int = LIVE_MS) -> DataFrame:
    """A row when a session starts to run and one when it has been still for `span_ms`, by the clock and not by later events."""
    return keyed(events.select("session_id", F.unix_millis("observed_at").alias("ms")), "session_id", Liveness(span_ms), Liveness.SHAPE, "ProcessingTime")


class Minutes(StatefulProcessor):
    """Events of a minute, as a running count that ends when the minute has left the view."""

    SHAPE = "minute timestamp, shard long, n long"

    def __init__(self, minutes: int):
        self.span = minutes * 60_000

    def init(self, handle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues):
        end = int(key[0]) * 60_000 + self.span
        new = sum(len(part) for part in rows)
        if end <= timerValues.getCurrentProcessingTimeInMs():
            return  # too old for the view
        before = self.count.get()[0] if self.count.exists() else None
        if before is None:
            self.handle.registerTimer(end)
        self.count.update(((before or 0) + new,))
        yield self._told(key, (before or 0) + new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.count.clear()
        yield self._told(key, 0)

    def _told(self, key, n: int) -> pd.DataFrame:
        return pd.DataFrame({"minute": [pd.Timestamp(int(key[0]) * 60_000, unit="ms", tz="UTC")], "shard": [int(key[1])], "n": [n]})

    def close(self) -> None:
        pass


def live_minutes(events: DataFrame, minutes: int = TIMELINE_MINUTES, shards: int = 16) -> DataFrame:
    """The rolling view of the last `minutes` minutes: each minute's running count as it grows, and 0 when the minute leaves the view, by the
    clock and without new events. A minute is shared out over `shards` keys by file; minutes_now() adds the last count of each."""
    shard = F.pmod(F.xxhash64("source_path"), F.lit(shards))
    rows = events.select(F.floor(F.unix_millis("observed_at") / 60_000).cast("long").alias("at"), shard.alias("shard"))
    return keyed(rows, ["at", "shard"], Minutes(minutes), Minutes.SHAPE, "ProcessingTime")


def minutes_now(told: DataFrame) -> DataFrame:
    """minute and n, from a table of the rows of live_minutes(): counts only grow until the 0 that ends them."""
    last = told.groupBy("minute", "shard").agg(F.max("n").alias("n"), F.min("n").alias("least"))
    return last.where("least > 0").groupBy("minute").agg(F.sum("n").alias("n"))
