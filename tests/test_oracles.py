"""Every query of the reference's operators against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from siftwell.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    rows = result.fetchall()
    assert found == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query_without_oracle_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
