import os
import sys
import tempfile
import time

import pytest

# Naive datetimes in tests are UTC, wherever they run.
os.environ["TZ"] = "UTC"
time.tzset()

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from touchline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        8, "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="touchline-tests-"),
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="touchline-warehouse-"),
        },
    )
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="touchline-test-")
