"""The queries of this subpackage that SQL can express, against their SQL, on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from rosterloom.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    wanted = connection.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, frame.select(*columns).collect()), key=str) == sorted(wanted, key=str)
