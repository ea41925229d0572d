"""Every query that has SQL must give the same rows as DuckDB on the smallest tables."""

import pytest

from tests.compare import connect, differences
from tidewatch.plans import load_catalogue

FOLDER = "/root/testdata/sf0.001"
CATALOGUE = load_catalogue()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n, e in CATALOGUE.items() if e.oracle])
def test_same_rows(spark, con, name):
    entry = CATALOGUE[name]
    assert differences(entry.build(spark, FOLDER), con, entry.oracle) == []
