"""Batch scan of a tree of JSONL logs."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionmill.functions.events import enriched, parsed
from sessionmill.functions.text import trim_all

LINES = "source_path string, fallback_id string, line_index bigint, raw string, observed_at timestamp"


def expand(root: str) -> str:
    """A leading ~ as the home folder."""
    return os.path.expanduser(root) if root == "~" or root.startswith("~/") else root


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _numbered(lines: DataFrame, counted: Column) -> DataFrame:
    """Adds line_index: how many `counted` lines of the file came before, over all its parts.

    A large file is read in parts, each by one task from its first line to its last. The lines of a
    part are numbered by their place in the task; a small table of one row for each part says how many
    lines came before it.
    """
    lines = lines.withColumn("place", F.monotonically_increasing_id()).withColumn("counted", counted)
    parts = lines.groupBy("source_path", "part").agg(F.min("place").alias("first"), F.count_if("counted").alias("n"))
    before = Window.partitionBy("source_path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source_path", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(parts, ["source_path", "part"])


def read_lines(spark: SparkSession, root: str, index: str = "physical") -> DataFrame:
    """One row for each line of each *.jsonl file below `root` (the suffix is case-sensitive).

    Files of any size are read in parts by many tasks. line_index counts all lines from 0, or with
    index="nonempty" only those that are not blank. A missing root gives no rows. A line that is not
    UTF-8 is skipped but counted; the others of its file stay, whatever characters they hold.
    observed_at is the file's time of modification.
    """
    root = expand(root)
    if index not in ("physical", "nonempty"):
        raise ValueError(f"unknown line numbering {index!r}")
    if not _exists(spark, root):
        return spark.createDataFrame([], LINES)
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(root)
    lines = lines.select(
        F.col("_metadata.file_path").alias("source_path"),
        F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*$", 1).alias("fallback_id"),
        F.col("_metadata.file_block_start").alias("part"),
        F.col("_metadata.file_modification_time").alias("observed_at"),
        F.col("value").alias("raw"),
    )
    valid = F.is_valid_utf8("raw")
    blank = valid & (trim_all(F.when(valid, F.col("raw"))) == "")
    if index == "physical":
        lines = _numbered(lines, F.lit(True)).withColumn("line_index", F.col("before") + F.col("place") - F.col("first"))
        lines = lines.where(valid & ~blank)
    else:
        lines = _numbered(lines, valid & ~blank).where("counted")
        lines = lines.withColumn("line_index", F.col("before") + F.row_number().over(Window.partitionBy("source_path", "part").orderBy("place")) - 1)
    return lines.select("source_path", "fallback_id", F.col("line_index").cast("long").alias("line_index"), "raw", "observed_at")


def read_events(spark: SparkSession, root: str, index: str = "physical", observed_at: str | None = None) -> DataFrame:
    """The event table of a log tree. `observed_at`: SQL for the time of arrival; by default an event's own time, else that of its file."""
    lines = read_lines(spark, root, index)
    if observed_at is not None:
        return enriched(lines.withColumn("observed_at", F.expr(observed_at).cast("timestamp")))
    events = enriched(lines)
    return events.withColumn("observed_at", F.col("event_ts"))


def corrupt_lines(spark: SparkSession, root: str) -> DataFrame:
    """The lines that hold no JSON value."""
    return parsed(read_lines(spark, root), keep_bad=True).where("entry is null").drop("entry")


def ingest_count(spark: SparkSession, root: str) -> int:
    """How many events a log tree holds."""
    return parsed(read_lines(spark, root)).count()
