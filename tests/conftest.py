import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from holdfast.session import local_session, shared_path  # noqa: E402
from holdfast.sources.tables import ensure_database  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(os.environ.get("TEST_CPUS", "8"), name="holdfast-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def database(spark):
    location = shared_path(spark, "testdb")
    name = location.rsplit("/", 1)[1].replace("-", "_")
    ensure_database(spark, name, location)
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")
