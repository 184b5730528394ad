"""Every registered query against its SQL in DuckDB, on whole tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from casebook.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if value is None or value is pd.NaT:
            return "null"
        return f"{value:.6f}" if isinstance(value, float) else str(value)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, con, name):
    df = catalogue.queries()[name](spark, FOLDER)
    got = df.collect()
    result = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert comparable(got, df.columns) == comparable(want, columns)
    assert len(got) > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["query_id", "context"] and df.count() == 40
