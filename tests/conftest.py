import os
import sys
from datetime import date, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def readings(spark):
    """Frame of raw readings from (entity, metric, ISO day, value) tuples."""
    def make(rows):
        data = [(e, m, date.fromisoformat(d) if isinstance(d, str) else d, v)
                for e, m, d, v in rows]
        return spark.createDataFrame(
            data, "entity_id string, metric string, observed_at date, value double")
    return make


@pytest.fixture
def stations(spark):
    def make(rows):
        return spark.createDataFrame(
            rows, "entity_id string, station_name string, state string, region string, "
                  "latitude double, longitude double")
    return make


def days(start: str, n: int):
    first = date.fromisoformat(start)
    return [first + timedelta(days=i) for i in range(n)]
