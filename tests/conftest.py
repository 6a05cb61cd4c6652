import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from gridpulse import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "gridpulse-tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """A DataFrame out of tuples and a schema text; timestamps may be given as text."""

    def build(rows, schema):
        from pyspark.sql import functions as F

        columns = [c.strip().rsplit(" ", 1) for c in schema.split(",")]
        loose = ", ".join(f"{n} {'string' if t == 'timestamp' else t}" for n, t in columns)
        df = spark.createDataFrame(rows, loose)
        return df.select(*[F.col(n).cast(t).alias(n) for n, t in columns])

    return build
