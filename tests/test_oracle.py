"""Every registered query of the roster engine against its SQL, on the smallest tables."""

import datetime
import decimal
import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from rosterloom.queries import ORACLE_SQL, QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def connection():
    found = duckdb.connect()
    for name in TABLES:
        path = f"{DATA}/{name}.parquet"
        files = glob.glob(f"{path}/*.parquet") if os.path.isdir(path) else [path]
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet({files!r})")
    return found


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat().replace("T00:00:00", "")
    return value


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connection, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = ordered(frame.select(*(f"`{c}`" for c in columns)).collect())
    answer = connection.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({ORACLE_SQL[name]})")
    assert got == ordered(answer.fetchall())
