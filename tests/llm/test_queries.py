"""Training-data queries with SQL, on the smallest data: the same values as DuckDB."""

import os

import pytest

import __spark_entry__ as entry
from rolloutlake.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_values_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = con.execute(queries.ORACLE[name])
    told = [c[0] for c in cursor.description]
    assert sorted(told) == columns
    want = sorted(repr(tuple(r[told.index(c)] for c in columns)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want
