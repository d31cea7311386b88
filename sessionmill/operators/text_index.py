"""Free-text search over a stored event table that opens only files which can hold the text.

For each file of the table the index has a bitmap of the trigrams of its search texts, in pieces of 4 KB. A text of three characters and
more can only be in a file that has all its trigrams, so a search reads the few pieces with their bits, then the files that pass, and
there compares as without an index: the rows are the same. Short texts read all files, and so do files that are newer than the index.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.operators.search import FilterSpec, feed, searchable

#: Bits of a file, and of one piece (the size that Spark's bitmap functions have).
BITS, PIECE = 1 << 20, 1 << 15
#: Characters that are turned into trigrams at once, about.
_STEP = 1 << 20


def trigram_bits(text: str) -> np.ndarray:
    """The bits of a text's trigrams, in no order, some more than once."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + codes[2:]
        mixed *= np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)


def _bitmaps(batches):
    """file, piece and bitmap of what a task has read."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        waiting: dict[str, list[str]] = {}
        for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                waiting.setdefault(file, []).append(text)
        for file, texts in waiting.items():
            bits = held.setdefault(file, np.zeros(BITS, bool))
            size, some = 0, []
            for text in [*texts, None]:
                if some and (text is None or size > _STEP):
                    bits[trigram_bits("\0\0".join(some))] = True
                    size, some = 0, []
                if text:
                    some.append(text)
                    size += len(text)
        if len(held) > 64:  # a task of many small files
            yield from _told(held)
            held = {}
    yield from _told(held)


def _told(held: dict[str, np.ndarray]):
    for file, bits in held.items():
        pieces = np.packbits(bits.reshape(-1, PIECE), axis=1, bitorder="little")
        some = np.flatnonzero(pieces.any(axis=1))
        yield pa.RecordBatch.from_pydict({"file": [file] * len(some), "piece": pa.array(some, pa.int64()), "bitmap": pa.array([pieces[i].tobytes() for i in some.tolist()], pa.binary())})


def _files(table: DataFrame) -> dict[str, str]:
    """The files of a table by the name that rows give them; what to read them by."""
    return {re.sub("^file:/+", "/", f): unquote(f) for f in table.inputFiles()}


def index_files(spark: SparkSession, table: str, index: str) -> int:
    """Add the files of a stored event table that the index lacks; returns how many. A file whose events have no text gets an empty piece."""
    known = indexed_files(spark, index)
    new = {name: f for name, f in _files(spark.read.parquet(table)).items() if name not in known}
    if not new:
        return 0
    events = spark.read.option("basePath", table).parquet(*new.values())
    texts = searchable(events).select(F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("file"), "search_text")
    # A file that several tasks read has pieces from each of them.
    pieces = texts.mapInArrow(_bitmaps, "file string, piece long, bitmap binary").groupBy("file", "piece").agg(F.expr("bitmap_or_agg(bitmap)").alias("bitmap"))
    none = spark.createDataFrame([(f,) for f in new], "file string").select("file", F.lit(-1).cast("long").alias("piece"), F.lit(b"").alias("bitmap"))
    pieces.unionByName(none).repartitionByRange("piece", "file").sortWithinPartitions("piece", "file").write.mode("append").parquet(index)
    return len(new)


def _index(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.schema("file string, piece long, bitmap binary").parquet(index)


def indexed_files(spark: SparkSession, index: str) -> set[str]:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(index)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return set()
    return {r["file"] for r in _index(spark, index).where("piece = -1").select("file").distinct().collect()}  # names of files, which the driver lists anyway


def files_that_may_hold(spark: SparkSession, table: str, index: str, text: str) -> list[str]:
    """The files of the table that a search for a text has to read."""
    files, known = _files(spark.read.parquet(table)), indexed_files(spark, index)
    text = text.lower()
    if len(text) < 3 or not known:
        return [*files.values()]
    needed: dict[int, list[int]] = {}
    for bit in sorted(set(trigram_bits(text).tolist())):
        needed.setdefault(bit // PIECE, []).append(bit % PIECE)

    def hold(batches):
        for batch in batches:
            good = []
            for piece, bitmap in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                held = np.frombuffer(bitmap.as_buffer(), np.uint8)
                bits = np.array(needed[piece])
                good.append(bool(((held[bits >> 3] >> (bits & 7)) & 1).all()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good, pa.bool_()))], ["file"])

    pieces = _index(spark, index).where(F.col("piece").isin(sorted(needed)))
    passed = pieces.mapInArrow(hold, "file string").groupBy("file").count().where(F.col("count") == len(needed))
    may = {r["file"] for r in passed.collect()}
    return [f for name, f in files.items() if name in may or name not in known]


def indexed_feed(spark: SparkSession, table: str, index: str, view: FilterSpec) -> DataFrame:
    """The events of a stored table that a view shows, as feed() gives them, from the files that may hold the text."""
    whole = spark.read.parquet(table)
    files = files_that_may_hold(spark, table, index, view.search)
    rows = spark.read.schema(whole.schema).option("basePath", table).parquet(*files) if files else whole.limit(0)
    return feed(rows, view)
