"""Every query that has SQL gives the rows that another engine gives."""

import os

import pytest

from sparkloom import catalog
from sparkloom.sources import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def shown(rows):
    return sorted(tuple("null" if v is None else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, oracle, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    wanted = oracle.sql(catalog.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(wanted.columns)
    place = [wanted.columns.index(c) for c in columns]
    assert shown([r[c] for c in columns] for r in df.collect()) == shown([r[i] for i in place] for r in wanted.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry_points

    assert set(catalog.QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0
