"""Every registered query next to its SQL on the given tables (folder: TILLWATCH_SF)."""

import os

import pytest
from compare import connect, differences

from tillwatch.catalog import QUERIES, SQL

FOLDER = os.environ.get("TILLWATCH_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def fresh(spark):
    """A session of its own: no views, caches by name or settings that other tests left."""
    return spark.newSession()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(fresh, con, name):
    assert differences(fresh, con, FOLDER, QUERIES[name], SQL[name]) == []


def test_sql_is_registered_for_known_queries_only():
    assert set(SQL) <= set(QUERIES)
