"""Bookmarks and tags beside the logs: small tables that join the session facts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a sidecar table that are sent to all executors; a larger one is joined by a shuffle.
MAX_BROADCAST = 100_000


def bookmarks_table(spark: SparkSession, ids: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(i,) for i in sorted(set(ids))], "session_id string")


def tags_table(spark: SparkSession, tags: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in tags.items() if v], "session_id string, tags array<string>")


def toggled(ids: set[str], one: str) -> set[str]:
    """With the id if it was absent, else without it."""
    return ids ^ {one}


def toggled_rows(bookmarks: DataFrame, ids: DataFrame) -> DataFrame:
    """A bookmarks table with each session of `ids` added if it was absent, else taken out."""
    marks = bookmarks.select("session_id").distinct().withColumn("n", F.lit(1)).unionByName(ids.select("session_id").distinct().withColumn("n", F.lit(1)))
    return marks.groupBy("session_id").agg(F.sum("n").alias("n")).where("n = 1").select("session_id")


def add_tags(tags: Column, more: Column) -> Column:
    """Union in order of first appearance."""
    return F.array_distinct(F.concat(F.coalesce(tags, F.array().cast("array<string>")), more))


def remove_tag(tags: Column, tag: str) -> Column:
    """NULL once no tag is left."""
    rest = F.array_remove(tags, tag)
    return F.when(F.size(rest) > 0, rest)


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else table


def with_sidecar(facts: DataFrame, bookmarks: DataFrame, tags: DataFrame) -> DataFrame:
    """Adds bookmarked and tags to session facts."""
    marked = _small(bookmarks.select("session_id").distinct().withColumn("bookmarked", F.lit(True)))
    tagged = _small(tags.dropDuplicates(["session_id"]))
    rows = facts.join(marked, "session_id", "left").join(tagged, "session_id", "left")
    return rows.withColumns({"bookmarked": F.coalesce("bookmarked", F.lit(False)), "tags": F.coalesce("tags", F.array().cast("array<string>"))})


def bookmarked_first(facts: DataFrame) -> DataFrame:
    return facts.orderBy(F.desc("bookmarked"), F.desc("last_seen"), "session_id")


def retained(events: DataFrame, cap: int = 50_000, share: float = 0.1) -> DataFrame:
    """What is left of a feed under a cap: over `cap` events the oldest go until (1 - share) of the cap is left."""
    keep = int(cap * (1 - share))
    if events.limit(cap + 1).count() <= cap:
        return events
    return events.orderBy(F.desc("observed_at"), F.desc("seq")).limit(keep)
