import os

import pytest

from rowmill.session import get_spark

SMALL = os.environ.get("ROWMILL_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = get_spark("rowmill-tests", master="local[8]", shuffle_partitions=4, driver_memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SMALL
