"""Every registered query of the plans against its SQL oracle, on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from broadsheet import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.registered()))
def test_query_equals_its_oracle(spark, duck, name):
    query, sql = plans.registered()[name]
    found = query(spark, DATA)
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(found.columns) == sorted(names)
    assert _rows(found.columns, found.collect()) == _rows(names, cursor.fetchall())
