"""A growing log tree as a stream: the `session_tail` data source.

An offset holds, for each file, the bytes seen so far and a generation, which rises when a file shrinks or is replaced by a shorter
one. The driver asks for sizes only and opens no log. A batch takes a stretch of bytes of each file, cut into parts of bounded size;
a line belongs to the part that its line end is in, so a line without one waits for the rest, and no part depends on how the
stretch was cut. Executors look for where their first line begins and number the lines.

To number them, a part needs the count of lines before it. The task that reads a part leaves that count for its end in a ledger, a
folder that all executors share, so the next one counts from there. The ledger holds nothing that the files do not: where a count is
missing, tasks count from the last one before it, or from the start of the file. Files must be where all executors can open them.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sessionmill.functions.events import enriched
from sessionmill.sources.logs import expand

NAME = "session_tail"
SCHEMA = "source_path string, fallback_id string, generation bigint, line_index bigint, raw string, observed_at timestamp"
_BLANK = b" \t\n\r\x0b\x0c"
#: Bytes of one file that a micro-batch takes, at most, and bytes that one task reads of them.
MAX_BYTES, PART_BYTES = 64 << 20, 16 << 20
#: Bytes that are read at once to find where a line begins.
_STEP = 1 << 16


@dataclass
class Stretch(InputPartition):
    """Bytes since..until of a file; floor: where the batch begins in it."""

    path: str
    generation: int
    since: int
    until: int
    floor: int


def log_sizes(root: str) -> dict[str, int]:
    """The size of each *.jsonl file below a folder (the suffix in this case only)."""
    found, folders = {}, [root]
    while folders:
        try:
            with os.scandir(folders.pop()) as entries:
                for e in entries:
                    try:
                        if e.is_dir(follow_symlinks=False):
                            folders.append(e.path)
                        elif e.name.endswith(".jsonl") and e.is_file():
                            found[e.path] = e.stat().st_size
                    except FileNotFoundError:
                        continue
        except (FileNotFoundError, PermissionError):
            continue
    return dict(sorted(found.items()))


def line_start(f, at: int) -> int:
    """The first byte of the line that byte `at` belongs to."""
    while at > 0:
        step = min(_STEP, at)
        f.seek(at - step)
        found = f.read(step).rfind(b"\n")
        if found >= 0:
            return at - step + found + 1
        at -= step
    return 0


def lines_ending(path: str, since: int, until: int) -> Iterator[bytes]:
    """The lines whose line end is one of the bytes since..until."""
    with open(path, "rb") as f:
        at = line_start(f, since)
        f.seek(at)
        while at < until:
            line = f.readline()
            at += len(line)
            if at > until or not line.endswith(b"\n"):
                return
            yield line


def counts(line: bytes) -> bool:
    """Whether a line has a number: all but blank ones, even those that are not UTF-8."""
    core = line.strip(_BLANK)
    return bool(core) and (32 < core[0] < 127 or bool(core.decode("utf-8", "replace").strip()))


class Ledger:
    """How many lines of a file with a number end before a byte, for some bytes."""

    def __init__(self, folder: str | None, path: str, generation: int):
        name = hashlib.sha1(f"{generation}:{path}".encode()).hexdigest()
        self.path, self.folder = path, folder and os.path.join(folder, name[:2], name)

    def known(self) -> dict[int, int]:
        """Entries are files named by byte and count, made whole by renaming."""
        try:
            names = os.listdir(self.folder) if self.folder else []
        except FileNotFoundError:
            names = []
        return {int(a): int(b) for a, _, b in (n.partition("-") for n in names) if a.isdigit() and b.isdigit()}

    def before(self, at: int) -> int:
        start, n = max(((a, n) for a, n in self.known().items() if a <= at), default=(0, 0))
        return n + sum(map(counts, lines_ending(self.path, start, at)))

    def note(self, at: int, n: int, floor: int) -> None:
        """Keep a count, and of earlier ones only that of where the batch begins, which a repeated batch needs."""
        if not self.folder:
            return
        os.makedirs(self.folder, exist_ok=True)
        draft = os.path.join(self.folder, f".{uuid.uuid4().hex}")
        open(draft, "w").close()
        os.replace(draft, os.path.join(self.folder, f"{at}-{n}"))
        for a, b in self.known().items():
            if a < floor:
                try:
                    os.remove(os.path.join(self.folder, f"{a}-{b}"))
                except FileNotFoundError:
                    pass  # another task of the batch was quicker


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root = expand(options["path"])
        self.earliest = options.get("startingoffsets", options.get("startingOffsets", "earliest")) == "earliest"
        self.most = int(options.get("maxbytes", options.get("maxBytes", MAX_BYTES)))
        self.part = int(options.get("partbytes", options.get("partBytes", PART_BYTES)))
        self.ledger = options.get("ledger") or None
        self.seen: dict[str, list[int]] | None = None

    def initialOffset(self) -> dict:
        """Nothing taken; or, to start at the end, all bytes that are there: a line that ends later is new."""
        return {} if self.earliest else {p: [n, 0] for p, n in log_sizes(self.root).items()}

    def latestOffset(self) -> dict:
        # The engine plans from the last offset it was given; after a restart that comes by partitions().
        before = self.seen if self.seen is not None else self.initialOffset()
        now = {}
        for path, size in log_sizes(self.root).items():
            byte, generation = before.get(path, [0, 0])
            if size < byte:
                byte, generation = 0, generation + 1
            now[path] = [min(size, byte + self.most), generation]
        self.seen = before | now
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self.seen = dict(end) if self.seen is None else self.seen
        out = []
        for path, (until, generation) in sorted(end.items()):
            since, old = start.get(path, [0, generation])
            since = since if old == generation else 0
            out += [Stretch(path, generation, a, min(a + self.part, until), since) for a in range(since, until, self.part)]
        return out or [Stretch("", 0, 0, 0, 0)]

    def read(self, part: Stretch):
        import datetime

        if part.until <= part.since:
            return
        fallback = os.path.splitext(os.path.basename(part.path))[0]
        now = datetime.datetime.now(datetime.timezone.utc)
        ledger = Ledger(self.ledger, part.path, part.generation)
        line = ledger.before(part.since)
        for raw in lines_ending(part.path, part.since, part.until):
            if not counts(raw):
                continue
            try:
                yield (part.path, fallback, part.generation, line, raw.decode("utf-8"), now)
            except UnicodeDecodeError:
                pass  # skipped, but numbered
            line += 1
        ledger.note(part.until, line, part.floor)


class SessionTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema):
        return TailReader(self.options)


def _ledger(spark: SparkSession) -> str | None:
    """A new folder beside the checkpoints, if the session names a place for those that tasks can open."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    named = (named or "").removeprefix("file://")
    return os.path.join(named, "session_tail", uuid.uuid4().hex) if named.startswith("/") else None


def tail_lines(spark: SparkSession, root: str, starting: str = "earliest", max_bytes: int = MAX_BYTES, part_bytes: int = PART_BYTES, ledger: str | None = None) -> DataFrame:
    """A stream of raw lines. `starting`: earliest, or latest to skip what is already there. A missing root is made.

    `ledger`: a folder for counts of lines, of this query alone, as another one may have met other generations of a file. By default a new
    one below spark.checkpoint.dir; a query that is started again with its old one need not count again. Without a ledger every batch
    counts its files from their start.
    """
    os.makedirs(expand(root), exist_ok=True)
    spark.dataSource.register(SessionTail)
    options = {"startingOffsets": starting, "maxBytes": str(max_bytes), "partBytes": str(part_bytes), "ledger": ledger or _ledger(spark) or ""}
    return spark.readStream.format(NAME).options(**options).load(expand(root))


def tail_events(spark: SparkSession, root: str, starting: str = "earliest", max_bytes: int = MAX_BYTES, **options) -> DataFrame:
    """A stream of events. A file's generation is part of its path in `source_path`, so that lines of a replaced file are new events."""
    lines = tail_lines(spark, root, starting, max_bytes, **options)
    path = F.when(F.col("generation") == 0, F.col("source_path")).otherwise(F.concat("source_path", F.lit("#"), F.col("generation").cast("string")))
    return enriched(lines.withColumn("source_path", path))
