import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from evraklab.session import configure, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = configure(local_session(4, "4g"))
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    return session


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture
def values(spark):
    """Evaluate a column over a list of values, in order."""

    def run(column_of, items, type_="string"):
        df = spark.createDataFrame(list(enumerate(items)), f"i int, x {type_}")
        return [r[0] for r in df.orderBy("i").select(column_of(df["x"]).alias("y")).collect()]

    return run
