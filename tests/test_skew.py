"""All registered queries on tables where one key, or one text, holds a third of the rows."""

import duckdb
import pytest

from casebook.plans import catalogue
from tests.test_queries import FOLDER, TABLES, comparable

SKEWED = {
    "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id) FROM t",
    "conversations": """
        SELECT * EXCLUDE (hot, n)
               REPLACE (CASE WHEN hot THEN 0 ELSE conv_id END AS conv_id,
                          CASE WHEN hot THEN 1000 + n ELSE turn END AS turn,
                          CASE WHEN hot AND role = 'user' THEN 'What does the regulation mention?' ELSE text END AS text)
        FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS n, n % 3 = 0 AS hot FROM t)""",
    "documents": """
        SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN (SELECT text FROM t WHERE doc_id = 1) ELSE text END AS text,
                          CASE WHEN doc_id % 3 = 0 THEN (SELECT n_chars FROM t WHERE doc_id = 1) ELSE n_chars END AS n_chars)
        FROM t""",
    "embeddings": """
        SELECT * REPLACE (CASE WHEN vec_id % 3 = 0 THEN (SELECT embedding FROM t WHERE vec_id = 1)
                          ELSE embedding END AS embedding)
        FROM t""",
    "benchmark": """
        SELECT * REPLACE (CASE WHEN item_id % 3 = 0 THEN (SELECT text FROM t WHERE item_id = 1) ELSE text END AS text)
        FROM t""",
    "lineitem": "SELECT * REPLACE (CASE WHEN l_linenumber = 1 THEN 7 ELSE l_partkey END AS l_partkey) FROM t",
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for name in TABLES:
        query = SKEWED.get(name, "SELECT * FROM t")
        con.execute(f"CREATE OR REPLACE VIEW t AS SELECT * FROM '{FOLDER}/{name}.parquet'")
        con.execute(f"COPY ({query}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_on_skewed_tables(spark, skewed, name):
    folder, con = skewed
    df = catalogue.queries()[name](spark, folder)
    result = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert comparable(df.collect(), df.columns) == comparable(result.fetchall(), columns)
