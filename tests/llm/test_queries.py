"""The queries of this package that SQL can express, against it, and the registration of all."""

import duckdb
import pytest

import __spark_entry__ as contract
from casebook.llm.queries import oracle_sql, queries
from tests.test_queries import FOLDER, TABLES, comparable


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = queries()[name](spark, FOLDER)
    result = con.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert comparable(df.collect(), df.columns) == comparable(result.fetchall(), columns)


def test_registration():
    names = contract.queries()
    assert {name.split("_")[0] for name in queries()} == {f"op{n}" for n in range(1, 14)}
    assert queries().keys() <= names.keys() and "pipeline" in names
    assert oracle_sql().keys() <= contract.oracle_sql().keys()
