"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from check_queries import TABLES, rows_of
from leafmeter.queries import all_queries

FOLDER = "/root/testdata/sf0.001"
# Queries of the training-data operators have tests of their own.
QUERIES = all_queries()
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_every_query_has_its_sql():
    assert QUERIES.keys() <= ORACLES.keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows_of(df.columns, df.collect())
    res = duck.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, res.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() == 50
