"""The registered exports hold whole conversations, also beyond the ring of 5,000 events."""

import pytest
from helpers import assert_same

from sessionmill.plans.queries import ORACLE_SQL, QUERIES

TURNS = 5_200


@pytest.mark.parametrize("name", ["export_jsonl", "export_messages"])
def test_long_conversation(spark, tmp_path, name):
    import duckdb

    rows = spark.range(TURNS).selectExpr("1L AS conv_id", "CAST(id AS INT) AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id) AS text")
    rows.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert_same(QUERIES[name](spark, str(tmp_path)), con, ORACLE_SQL[name])
