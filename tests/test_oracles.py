"""Every job against its SQL twin on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from lakeframe.jobs import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        return None if math.isnan(value) else str(round(float(value), 5) + 0.0)
    if isinstance(value, datetime.date):
        return value.isoformat()
    return str(value)


def rows_of(rows, order):
    return sorted(tuple(map(str, (plain(r[i]) for i in order))) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    twin = duck.sql(ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(twin.columns)
    got = rows_of([tuple(r) for r in found.collect()], [found.columns.index(c) for c in columns])
    assert got == rows_of(twin.fetchall(), [twin.columns.index(c) for c in columns])
