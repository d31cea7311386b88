"""Search with a trigram index: the same rows as without, from fewer files."""

import random

import numpy as np
import pytest
from helpers import events_of
from pyspark.sql import functions as F

from sessionmill.operators import text_index as I
from sessionmill.operators.search import FilterSpec, feed


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def stored(events, path, mode="append"):
    events.withColumn("entry", F.to_json("entry")).coalesce(1).write.mode(mode).parquet(path)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("events")
    rng = random.Random(1)
    rare = ["Zwölf Boxkämpfer", "NEEDLE in 7", "日本語のテキスト", "tail\\u00e9"]
    for i in range(12):
        entries = [{"type": "user", "sessionId": f"s{i}", "message": {"content": words(rng, 30)}} for _ in range(20)]
        if i % 3 == 0:
            entries.append({"type": "assistant", "sessionId": f"s{i}", "message": {"content": [{"type": "text", "text": rare[i // 3]}, {"type": "tool_use", "name": f"Tool{i}", "id": "x"}]}})
        stored(events_of(spark, *entries, path=f"{i}.jsonl"), f"{root}/t")
    assert I.index_files(spark, f"{root}/t", f"{root}/i") == 12
    return f"{root}/t", f"{root}/i"


@pytest.mark.parametrize("text,most", [("zwölf boxk", 2), ("needle IN", 2), ("本語の", 2), ("Tool9", 2), ("not there at all", 1), ("s11", 12), ("ab", 12), ("the", 12), ("", 12), ('"sessionId":"s3"', 2)])
def test_same_rows_from_fewer_files(spark, table, text, most):
    path, index = table
    assert len(I.files_that_may_hold(spark, path, index, text)) <= most
    for kind in ("all", "tool_use"):
        view = FilterSpec(type=kind, search=text)
        key = lambda rows: sorted(tuple(r) for r in rows.select("session_id", "source_path", "line_index", "entry").collect())
        assert key(I.indexed_feed(spark, path, index, view)) == key(feed(spark.read.parquet(path), view))


def test_no_search_loses_a_row(spark, table):
    """Pieces of texts that are there, wherever they are cut."""
    path, index = table
    rng = random.Random(2)
    rows = spark.read.parquet(path).select("entry", F.col("_metadata.file_path").alias("file")).collect()
    for r in rng.sample(rows, 25):
        at = rng.randrange(len(r["entry"]) - 12)
        found = I.files_that_may_hold(spark, path, index, r["entry"][at : at + rng.randrange(1, 12)])
        assert r["file"].rpartition("/")[2] in {f.rpartition("/")[2] for f in found}


def test_files_newer_than_the_index(spark, tmp_path):
    path, index = f"{tmp_path}/t", f"{tmp_path}/i"
    stored(events_of(spark, {"type": "user", "sessionId": "a", "message": {"content": "first words"}}), path)
    view = FilterSpec(search="second")
    assert I.indexed_feed(spark, path, index, view).count() == 0  # no index yet
    assert I.index_files(spark, path, index) == 1 and I.files_that_may_hold(spark, path, index, "second") == []
    assert I.indexed_feed(spark, path, index, view).count() == 0
    stored(events_of(spark, {"type": "user", "sessionId": "b", "message": {"content": "second words"}}), path)
    assert [r.session_id for r in I.indexed_feed(spark, path, index, view).collect()] == ["b"]
    assert (I.index_files(spark, path, index), I.index_files(spark, path, index)) == (1, 0)
    assert [r.session_id for r in I.indexed_feed(spark, path, index, view).collect()] == ["b"]
    assert len(I.files_that_may_hold(spark, path, index, "second")) == 1


def test_bits():
    assert len(I.trigram_bits("ab")) == 0 and len(I.trigram_bits("abcd")) == 2
    bits = I.trigram_bits("".join(chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676 % 26) for i in range(17_576)))
    assert 0 <= bits.min() and bits.max() < I.BITS and len(np.unique(bits)) > 15_000
