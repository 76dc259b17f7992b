import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tidepool.session import build_session
    s = build_session(app="tidepool-tests", master="local[4]", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def one(spark, value, col_type="string"):
    """A one-row frame with column ``x``."""
    return spark.createDataFrame([(value,)], f"x {col_type}")


def col_values(df, name):
    return [r[name] for r in df.collect()]
