"""The contract queries against their SQL on the smallest tables; the others have a row per input row."""

import duckdb
import pytest

from siftwell.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert found == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)


@pytest.mark.parametrize("name, table", [("op3_sstable", "documents"), ("op4_licences", "documents"), ("op7_toxicity", "documents"), ("op9_html_extraction", "pages")])
def test_query_has_a_row_per_row(spark, name, table):
    rows = spark.read.parquet(f"{DATA}/{table}.parquet").count()
    out = QUERIES[name](spark, DATA)
    assert out.count() == rows
    assert out.select(out.columns[0]).distinct().count() == rows
