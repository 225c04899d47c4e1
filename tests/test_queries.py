"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in check.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if name in SQL:
        result = db.execute(SQL[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == check.rows_of(columns, result.fetchall())


def test_flagship(spark):
    df = entry.entry(spark)
    assert {"transcript_id", "rank", "efficacy_score"} <= set(df.columns) and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
