import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from larder.session import build_session

    SparkSession.builder.config("spark.driver.memory", "4g").config(
        "spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="larder-test-")
    )
    s = build_session("tests", "local[8]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows():
    def take(df):
        return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))

    return take
