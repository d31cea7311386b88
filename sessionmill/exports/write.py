"""Where exports go: folders written by Spark, a single file or stream, a dataset folder."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.exports.fragments import BETWEEN_TRANSCRIPTS, HEAD, joints, write_export, write_one_file
from sessionmill.exports.markdown import transcripts
from sessionmill.exports.records import FORMATS, raw_lines, records
from sessionmill.operators.analytics import exact_sum
from sessionmill.operators.sessions import SESSION_RING, recent_per_session, with_costs_in_order

#: Formats with the suffix and media type of their files.
FILES = {
    "messages": ("jsonl", "application/x-ndjson"),
    "openai": ("jsonl", "application/x-ndjson"),
    "sharegpt": ("jsonl", "application/x-ndjson"),
    "jsonl": ("jsonl", "application/x-ndjson"),
    "markdown": ("md", "text/markdown; charset=utf-8"),
    "huggingface": ("jsonl", "application/x-ndjson"),
}
PREVIEW_CHARACTERS = 2_000


def export_filename(fmt: str, session_id: str | None = None, now: datetime | None = None) -> str:
    """A name for a download: the session's id with anything but letters, digits, - and _ as -; or a time stamp for several."""
    if session_id is not None:
        name = "".join(c if c.isalnum() or c in "-_" else "-" for c in session_id)
    else:
        name = f"sessions-{now or datetime.now(timezone.utc):%Y%m%dT%H%M%S}"
    return f"{name}.{FILES[fmt][0]}"


def exported(events: DataFrame, facts: DataFrame, fmt: str, max_events: int | None = SESSION_RING) -> DataFrame:
    """Rows of session_id and line (or text, for markdown), most recent session first.

    Of each session the last `max_events` events are shown, None for all; totals always cover all.
    """
    if fmt not in FILES:
        raise ValueError(f"unknown format {fmt!r}")
    own = events.join(facts.select("session_id"), "session_id", "left_semi")
    events = recent_per_session(own, max_events)
    if fmt == "markdown":
        facts = with_costs_in_order(facts, own)
        return transcripts(events, facts).orderBy(F.desc("last_seen"), "session_id").select("session_id", F.col("text").alias("line"))
    if fmt == "jsonl":
        lines = raw_lines(events).join(facts.select("session_id", "last_seen"), "session_id")
        return lines.orderBy(F.desc("last_seen"), "session_id", "seq").select("session_id", "line")
    name = "messages" if fmt == "huggingface" else fmt
    assert name in FORMATS
    return records(events, facts, name).orderBy(F.desc("last_seen"), "session_id").select("session_id", "line")


def write_folder(rows: DataFrame, path: str) -> None:
    """Part files, written in parallel; their names sort in the order of the rows."""
    rows.select("line").write.text(path)


def stream_text(rows: DataFrame, fmt: str) -> Iterator[str]:
    """The whole export as pieces of text, a partition at a time."""
    first = True
    for row in rows.select("line").toLocalIterator():
        if fmt == "markdown":
            yield row["line"] if first else BETWEEN_TRANSCRIPTS + row["line"]
        else:
            yield row["line"] + "\n"
        first = False


def previews(rows: DataFrame, n: int = PREVIEW_CHARACTERS) -> DataFrame:
    """The first n characters of each session's export."""
    return rows.select("session_id", F.left("line", F.lit(n)).alias("preview"))


def preview_text(rows: DataFrame, fmt: str, n: int = PREVIEW_CHARACTERS) -> str:
    """The first n characters; later partitions are not computed."""
    out = ""
    for piece in stream_text(rows, fmt):
        out += piece
        if len(out) >= n:
            break
    return out[:n]


def write_file(rows: DataFrame, fmt: str, path: str) -> None:
    """One file of an export's rows, written by many tasks; write_export() does the same for sessions of any size."""
    text = F.col("line") if fmt == "markdown" else F.concat("line", F.lit("\n"))
    write_one_file(rows.select(F.lit(HEAD).alias("kind"), text.alias("text")), path, joints(fmt))


def _write_small(spark: SparkSession, path: str, pieces: Iterable[str]) -> None:
    """One file, written by the driver, in whatever store the path names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        for piece in pieces:
            out.write(bytearray(piece.encode()))
    finally:
        out.close()


def dataset_numbers(facts: DataFrame) -> DataFrame:
    """One row of what a dataset holds."""
    return facts.agg(F.count(F.lit(1)).alias("num_examples"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("event_count", "input_tokens", "output_tokens")), F.coalesce(exact_sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))


def write_dataset(events: DataFrame, facts: DataFrame, path: str, max_events: int | None = SESSION_RING, one_file: bool = False) -> None:
    """A dataset folder: train.jsonl, dataset_info.json and a README.md card.

    train.jsonl is a folder of part files; with `one_file` it is a single file. Tasks write either in parallel, but only the
    latter way takes a session of any size.
    """
    spark = facts.sparkSession
    if one_file:
        write_export(events, facts, "huggingface", f"{path}/train.jsonl", max_events)
    else:
        write_folder(exported(events, facts, "huggingface", max_events), f"{path}/train.jsonl")
    t = dataset_numbers(facts).first()
    info = {
        "description": "Coding-agent sessions, one record each: `messages` holds user and assistant messages whose `content` is a string or a list of content blocks.",
        "citation": "",
        "license": "user-defined",
        "splits": {"train": {"name": "train", "num_examples": t["num_examples"]}},
    }
    _write_small(spark, f"{path}/dataset_info.json", [json.dumps(info, indent=2)])
    files = "train.jsonl" if one_file else "train.jsonl/*"
    # The keys and task names of the front matter.
    front = {"license": "other", "task_categories": ["conversational", "text-generation"], "pretty_name": "Work logs of coding agents"}
    told = [
        ("training records", f"{t['num_examples']:,}"),
        ("log events behind them", f"{t['event_count']:,}"),
        ("tokens read by the model", f"{t['input_tokens']:,}"),
        ("tokens written by the model", f"{t['output_tokens']:,}"),
        ("what that cost, at list prices", f"${t['cost_usd']:.2f}"),
    ]
    card = "".join(
        [
            "---\n",
            *(f"{k}: {v}\n" if isinstance(v, str) else f"{k}:\n" + "".join(f"  - {x}\n" for x in v) for k, v in front.items()),
            "---\n\n# What agents said and did\n\n| in this folder | |\n| --- | --- |\n",
            *(f"| {name} | {n} |\n" for name, n in told),
            "\nOne session is one JSON record: who spoke (`messages`), where and with what (`cwd`, `git_branch`, `version`, `model`), its `title`, and counts in `metadata`.\n",
            f'\n    datasets.load_dataset("json", data_files="{files}")\n',
        ]
    )
    _write_small(spark, f"{path}/README.md", [card])
