"""Events from literal entries, and rows held against DuckDB."""

import json
import math
import os

from sessionmill.functions.events import enriched

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def events_of(spark, *entries, session="file", start=0, path="a.jsonl"):
    """The event table of JSON lines (or of objects), numbered from `start`, a second apart."""
    lines = [(path, session, start + i, e if isinstance(e, str) else json.dumps(e), 1_700_000_000 + start + i) for i, e in enumerate(entries)]
    rows = spark.createDataFrame(lines, "source_path string, fallback_id string, line_index long, raw string, t long")
    return enriched(rows.selectExpr("source_path", "fallback_id", "line_index", "raw", "timestamp_seconds(t) AS observed_at"))


def one(spark, entry):
    return events_of(spark, entry).first()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(rows):
    def value(x):
        return "\0" if x is None else f"{x:.9g}" if isinstance(x, float) and not math.isnan(x) else str(x)

    return sorted(tuple(value(x) for x in r) for r in rows)


def assert_same(df, con, sql):
    names = sorted(df.columns)
    found = con.sql(sql)
    assert sorted(found.columns) == names
    got = plain(tuple(r) for r in df.select(*names).collect())
    want = plain(found.select(*(f'"{n}"' for n in names)).fetchall())
    assert len(got) == len(want)
    assert got == want
