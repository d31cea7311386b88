"""Small helpers that several corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that end a word.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"


def named(name: str) -> Column:
    """The column of just this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def words(text: Column) -> Column:
    """The words of a text, unchanged; none for null or blank text."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPACES))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One in so few parts that most cores would stand idle is dealt out anew; others are read as they are."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if 4 * rows.rdd.getNumPartitions() <= cores else rows


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes to differ from all columns of `df`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def set_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the shared folder that the cluster names; choose one only where none is named (local runs)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        import tempfile

        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(named)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    set_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder as Parquet and read them again, so that later steps read only the columns they need."""
    spark = df.sparkSession
    set_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


#: Rows under one key that a join still lets meet; a key with more is hot. Of hot keys there are at most MAX_HOT, those with the largest share.
HOT_ROWS, MAX_HOT = 10_000, 100_000


def spread_join(rows: DataFrame, facts: DataFrame, key: str, how: str = "left", n_rows: int | None = None) -> DataFrame:
    """Join `rows` (`n_rows` of them, if known) with `facts`, which has one row for each value of `key`, without meeting at a hot key.

    The facts of hot keys, whose number is bounded, are sent to every task, so their rows stay where
    they are; the other rows meet their facts by a shuffle. Both tables are read more than once: cut
    their lineage before.
    """
    if (rows.count() if n_rows is None else n_rows) <= HOT_ROWS:
        return rows.join(facts, key, how)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > HOT_ROWS) & F.col(key).isNotNull())
    hot = [r[0] for r in counts.orderBy(F.desc("n")).limit(MAX_HOT).select(key).collect()]  # bounded
    if not hot:
        return rows.join(facts, key, how)
    spark = rows.sparkSession
    named = F.broadcast(spark.createDataFrame([(x,) for x in hot], f"{key} {dict(rows.dtypes)[key]}"))
    few = F.broadcast(facts.join(named, key, "left_semi"))
    return rows.join(named, key, "left_semi").join(few, key, how).unionByName(rows.join(named, key, "left_anti").join(facts, key, how))
