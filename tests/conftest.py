import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from casebook.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[*]",
        "casebook-tests",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column on a one-row table."""
    return lambda column: spark.range(1).select(column.alias("v")).first().v
