"""All catalogue queries with SQL, on the smallest data: same columns and the same values as DuckDB, apart from row order."""

import os
from decimal import Decimal

import pytest

import __spark_entry__ as entry
from rolloutlake.plans import registry

DATA = "/root/testdata/sf0.001"


def values(rows):
    """Rows as sorted text; minus zero is zero, and a decimal is the number it says."""
    return sorted(repr(tuple(float(x) + 0.0 if isinstance(x, float | Decimal) else x for x in r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_values_equal_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = duck.execute(registry.ORACLE[name])
    told = [c[0] for c in cursor.description]
    assert sorted(told) == columns
    at = [told.index(c) for c in columns]
    want = [[r[k] for k in at] for r in cursor.fetchall()]
    assert values([r[c] for c in columns] for r in df.collect()) == values(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_queries_without_sql_run(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    assert entry.queries()[name](spark, DATA).columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.QUERIES) > 280
