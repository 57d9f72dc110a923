import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from etaforge.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        app="tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def rows(spark):
    """Make a frame from text rows and a DDL schema; timestamps are given as text."""

    def make(data, ddl):
        names = [part.split()[0] for part in ddl.split(", ")]
        kinds = dict(part.split() for part in ddl.split(", "))
        loose = ", ".join(f"{n} {'string' if k == 'timestamp' else k}" for n, k in kinds.items())
        df = spark.createDataFrame(data, loose)
        return df.selectExpr(*(f"cast({n} as {kinds[n]}) as {n}" for n in names))

    return make
