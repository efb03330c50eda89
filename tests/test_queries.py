"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from check_queries import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


OWN = [name for name in entry.queries() if name not in entry.text_queries()]


def test_every_query_has_sql():
    assert set(OWN) == set(entry.oracle_sql()) - set(entry.text_sql())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    outcome, _ = compare(spark, con, name, SF)
    assert outcome.startswith("ok"), outcome


def test_entry(spark):
    assert entry.entry(spark).count() == 10
