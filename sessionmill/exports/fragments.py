"""Exports as fragments: a session of any size is never put together in one place.

A record is a head, the items of its events, and a tail. Fragments sort by session and then by event over all tasks, so a session with a
third of all events is written by a third of the tasks. Each task writes its stretch to a part of its own; what stands between two
fragments (a comma, a line) depends on their kinds only, and at the border of two parts it is settled from what their tasks tell: size,
first kind and last kind. Prefix sums of the sizes then give each part its place in the one file, and tasks copy them there at once.

Parts are named by attempt, and only those that a finished task names are used; the file gets its name when all is in it. Paths must be
where all executors can open them.
"""

from __future__ import annotations

import os
import uuid
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.exports.markdown import headings, pieces
from sessionmill.exports.records import FORMATS, item_texts, raw_lines, record_ends
from sessionmill.operators.sessions import SESSION_RING, recent_per_session, with_costs_in_order

HEAD, ITEM, TAIL = 0, 1, 2
BETWEEN_TRANSCRIPTS = "\n\n---\n\n"
#: Sessions with more events do not meet their facts by a shuffle; of such there can be no more than a table has rows over this.
HOT_EVENTS, MAX_HOT = 100_000, 100_000
#: Bytes that are copied at once.
_STEP = 1 << 20


def joints(fmt: str) -> dict[tuple[int, int], str]:
    """What stands between a fragment of one kind and the next."""
    if fmt == "markdown":
        return {(kind, HEAD): BETWEEN_TRANSCRIPTS for kind in (HEAD, ITEM)}
    return {} if fmt == "jsonl" else {(ITEM, ITEM): ","}


def with_last_seen(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of the sessions of `facts`, with last_seen. A session with very many events finds it by broadcast, the others by a shuffle."""
    own = facts.select("session_id", "last_seen", (F.col("event_count") > HOT_EVENTS).alias("hot"))
    hot = own.where("hot").limit(MAX_HOT + 1).collect()
    own = own.drop("hot")
    if not hot or len(hot) > MAX_HOT:  # beyond that, no session is a large part of the whole
        return rows.join(own, "session_id")
    few = F.broadcast(rows.sparkSession.createDataFrame([(r["session_id"], r["last_seen"]) for r in hot], own.schema))
    names = few.select("session_id")
    return rows.join(few, "session_id").unionByName(rows.join(names, "session_id", "left_anti").join(own.join(names, "session_id", "left_anti"), "session_id"))


def fragments(events: DataFrame, facts: DataFrame, fmt: str, max_events: int | None = SESSION_RING) -> DataFrame:
    """kind and text of an export in order: most recent session first. Of each session the last `max_events` events are shown, None for all."""
    every_event, events = events, recent_per_session(events, max_events)
    no_seq = F.lit(None).cast(events.schema["seq"].dataType)
    if fmt == "jsonl":
        items, ends = raw_lines(events).select("session_id", "seq", F.concat("line", F.lit("\n")).alias("text")), None
    elif fmt == "markdown":
        items = pieces(events).select("session_id", "seq", F.col("piece").alias("text"))
        ends = headings(with_costs_in_order(facts, every_event)).select("session_id", "last_seen", F.lit(HEAD).alias("kind"), no_seq.alias("seq"), F.col("head").alias("text"))
    else:
        name = "messages" if fmt == "huggingface" else fmt
        items = item_texts(events, FORMATS[name][0])
        ends = record_ends(facts, name)
        ends = ends.select("session_id", "last_seen", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("text")) for k, c in ((HEAD, "head"), (TAIL, "tail"))))).alias("e"))
        ends = ends.select("session_id", "last_seen", "e.kind", no_seq.alias("seq"), "e.text")
    items = with_last_seen(items, facts).select("session_id", "last_seen", F.lit(ITEM).alias("kind"), "seq", "text")
    every = items if ends is None else items.unionByName(ends)
    return every.orderBy(F.desc("last_seen"), "session_id", "kind", "seq").select("kind", "text")


def write_one_file(rows: DataFrame, path: str, between: dict[tuple[int, int], str]) -> int:
    """Write the `text` of rows of kind and text, in their order, as one file; returns its size in bytes."""
    path = os.path.abspath(path.removeprefix("file://"))
    folder, run = os.path.dirname(path), uuid.uuid4().hex
    os.makedirs(folder, exist_ok=True)
    parts_at = os.path.join(folder, f".{os.path.basename(path)}-{run}")
    joined = {k: v.encode() for k, v in between.items()}

    def write(batches):
        context = TaskContext.get()
        os.makedirs(parts_at, exist_ok=True)
        name = os.path.join(parts_at, f"{context.partitionId()}-{context.taskAttemptId()}")
        first = last = None
        with open(name, "wb") as out:
            for batch in batches:
                for kind, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                    if last is None:
                        first = kind
                    else:
                        out.write(joined.get((last, kind), b""))
                    out.write(text.as_py())
                    last = kind
        if last is not None:
            yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "name": [name], "size": [os.path.getsize(name)], "first": [first], "last": [last]})

    told = rows.select(F.col("kind").cast("int"), "text").mapInArrow(write, "part long, name string, size long, first long, last long")
    parts = sorted(told.collect(), key=lambda r: r["part"])  # one row for each task
    places, at = [], 0
    for before, part in pairwise([None, *parts]):
        joint = joined.get((before["last"], part["first"]), b"") if before else b""
        places.append((part["name"], at, joint))
        at += len(joint) + part["size"]
    whole = os.path.join(parts_at, "whole")
    os.makedirs(parts_at, exist_ok=True)
    with open(whole, "wb") as out:
        out.truncate(at)

    def copy(batches):
        for batch in batches:
            for name, place, joint in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(name, "rb") as part, open(whole, "r+b") as out:
                    out.seek(place)
                    out.write(joint)
                    while held := part.read(_STEP):
                        out.write(held)
                yield pa.RecordBatch.from_pydict({"name": [name]})

    if places:
        spark = rows.sparkSession
        todo = spark.createDataFrame(places, "name string, place long, joint binary").repartition(len(places))
        done = {r["name"] for r in todo.mapInArrow(copy, "name string").collect()}
        assert done == {name for name, *_ in places}
    os.replace(whole, path)
    for name in os.listdir(parts_at):
        os.remove(os.path.join(parts_at, name))
    os.rmdir(parts_at)
    return at


def write_export(events: DataFrame, facts: DataFrame, fmt: str, path: str, max_events: int | None = SESSION_RING) -> int:
    """Write the sessions of `facts` as one file, whatever the size of a session; returns its size in bytes."""
    return write_one_file(fragments(events, facts, fmt, max_events), path, joints(fmt))
