import duckdb
import pytest

import __spark_entry__ as entry
import catalog

SF = "/root/testdata/sf0.001"
TABLES = ["events", "documents", "pages", "labels", "conversations", "embeddings"]


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_all_of_the_catalog_is_registered():
    assert catalog.QUERIES.keys() <= entry.queries().keys()
    assert catalog.ORACLE.keys() == catalog.QUERIES.keys()


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF)
    rows = got.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert ordered(got.columns, rows) == ordered(columns, want.fetchall())
