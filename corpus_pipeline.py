"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

1. quality: a classifier trained on the labels drops documents that it finds bad;
2. exact_dedup: one document of each group of equal texts stays;
3. near_dedup: one document of each group of near-equal texts (0.8 of their five-word shingles, in a chain) stays;
4. mix: all documents, sorted so that any stretch holds the sources by target weight;
5. pack: stretches of the mix are packed into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.llm import best_fit_packing, exact_dedup, pfair_mix, quality_model, simhash
from sessionmill.llm.common import shared_table, table

#: Documents with a lower score go. Low, as a clean document that is lost can't be had back later.
MIN_QUALITY = 0.3
#: Documents that are packed together, at most: a stretch of the mix.
LANE_ROWS = 16384

#: The classifier can't be put in SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.good_documents(docs, trees, MIN_QUALITY)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pfair_mix.mixed_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that stand together in a file of the mix share a lane; for rows that are not in files, lanes go by hash."""
    stretch = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / LANE_ROWS))
    lane = stretch if docs.inputFiles() else None
    return best_fit_packing.best_fit_packing(docs, lane=lane, lane_rows=LANE_ROWS)


STAGES = [("quality", quality), ("exact_dedup", dedup_exact), ("near_dedup", dedup_near), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
