import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from stationcast.session import local_session

    session = local_session(8, "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def panel(spark, sf):
    """The derived panel, written once."""
    from stationcast.session import durable
    from stationcast.sources.derived import panel

    return durable(panel(spark, sf))


@pytest.fixture(scope="session")
def raw(spark, sf):
    from stationcast.session import durable
    from stationcast.sources.derived import raw_readings

    return durable(raw_readings(spark, sf))


@pytest.fixture(scope="session")
def days(spark):
    """Build a small series frame: rows of (station, day number, value...)."""
    import datetime

    def build(rows, names=("pm25",), kind="double"):
        start = datetime.date(2021, 1, 1)
        out = [(s, start + datetime.timedelta(days=d), *v) for s, d, *v in rows]
        columns = ", ".join(f"{n} {kind}" for n in names)
        return spark.createDataFrame(out, f"station string, obs_date date, {columns}")

    return build
