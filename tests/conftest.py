import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillwise.session import local_session  # noqa: E402

SF = os.environ.get("TILLWISE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, partitions=4, app="tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def rows(spark):
    """List of tuples → DataFrame with a DDL schema."""

    def make(data, schema):
        return spark.createDataFrame(data, schema)

    return make
