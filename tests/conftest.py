import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tillwatch.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def failures(spark):
    from tillwatch.sources.failures import failures_from_tables

    return failures_from_tables(spark, SF).cache()


@pytest.fixture(scope="session")
def diagnoses(spark):
    from tillwatch.operators.diagnosis import default_diagnoses

    return default_diagnoses(spark).cache()
