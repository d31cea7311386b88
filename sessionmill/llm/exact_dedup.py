"""Exact dedup by skew-safe combining, with DataFrame operations only.

1. Rows of one input task with the same text combine before any shuffle (the map side of the first
   aggregation).
2. Those local winners meet in salted digest groups: the salt is the number of the input task, so
   a text with a third of all rows is spread over `salts` reducers, each of which gets at most one
   row per input task.
3. The at most `salts` winners of a text combine globally.

Every stage groups by the digest and the full content, so no digest is trusted to decide equality.
Only the way back from a row to its group goes by two independent digests; should two contents
share both, the job stops with an error instead of linking them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.common import free_names, named, normalised, table

#: A group of at least LARGE rows is large, or of 1/MAX_LARGE of all rows where that is more; there are at most MAX_LARGE such groups.
LARGE, MAX_LARGE = 1_000, 100_000


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    out = docs.select(named(id_col).alias("doc_id"), normalised(named(text_col)).alias("content"))
    return out.select("doc_id", "content", digest(F.col("content")).alias("digest"), F.xxhash64("content").alias("mark"))


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest=sha256_hex) -> DataFrame:
    """One row per distinct text: digest, mark, content, keep_id (smallest id), group_size."""
    identity = ["digest", "mark", "content"]
    salted = (
        _keyed(docs, id_col, text_col, digest)
        .groupBy((F.spark_partition_id() % salts).alias("salt"), *identity)
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return salted.groupBy(*identity).agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest=sha256_hex) -> DataFrame:
    """Return doc_id, keep_id, group_size, kept and digest, one row per input row.

    Texts are equal when identical after each run of ASCII white space became one space; null
    counts as empty. The row with the smallest id stays. Rows that share id and text are one
    document given twice: each is counted in group_size and carries kept = true. A null id never
    wins against another id. Other columns of `docs` are ignored, whatever their names. An empty
    table gives an empty result.
    """
    # Either column needs all sums, so that both uses of the groups below read one and the same shuffle.
    one = (F.col("contents") == 1) & (F.col("group_size") > 0)
    sole = lambda c: F.when(one, F.col(c)).otherwise(F.raise_error(F.lit("two contents share both digests")).cast("long")).alias(c)
    groups = (
        winners(docs, id_col, text_col, salts, digest)
        .groupBy("digest", "mark")
        .agg(F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("contents"))
        .select("digest", "mark", sole("keep_id"), sole("group_size"))
    )
    # A row finds its group by its digests. Large groups, of which there are at most MAX_LARGE, are
    # sent to every task; their rows then spread over the shuffle by keys of their own instead of
    # meeting under one.
    large = groups.where(F.col("group_size") >= max(LARGE, docs.count() // MAX_LARGE))
    large = large.select("digest", "mark", F.col("keep_id").alias("large_keep"), F.col("group_size").alias("large_size"))
    rows = _keyed(docs, id_col, text_col, digest).drop("content").join(F.broadcast(large), ["digest", "mark"], "left")
    held = F.col("large_size").isNotNull()
    rows = rows.withColumn("by", F.when(held, F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))).otherwise(F.col("digest").cast("string")))
    others = groups.select(F.col("digest").cast("string").alias("by"), "mark", "keep_id", "group_size")
    out = rows.join(others, ["by", "mark"], "left").select(
        "doc_id", F.when(held, F.col("large_keep")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("large_size", "group_size").alias("group_size"), "digest"
    )
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; of rows that share id and text one stays.

    The ids that stay come from exact_groups(); one join on (id, digest) brings the rows back. Rows
    that share both combine in their task before they are shuffled for it.
    """
    key = free_names(docs, "id_as_text", "text_digest")
    best = exact_groups(docs, id_col, text_col, salts).where("kept")
    best = best.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(key[0]), F.col("digest").alias(key[1]))
    rows = docs.withColumn(key[0], F.coalesce(named(id_col).cast("string"), F.lit("")))
    rows = rows.withColumn(key[1], sha256_hex(normalised(named(text_col))))
    return rows.dropDuplicates(key).join(best.distinct(), key, "left_semi").select(*map(named, docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY content) AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY content) AS kept,
       sha256(content) AS text_sha256
FROM d
"""
