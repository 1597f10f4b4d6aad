"""Every registered query against its SQL twin, and the driver contract."""

import pytest

import __spark_entry__ as entry
from lakeaudit.plans.catalog import QUERIES
from lakeaudit.plans.oracle import ORACLE
from tests.compare import check, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry.entry(spark).columns == ["path", "n"]


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_sql(spark, sf, con, key):
    assert check(spark, con, sf, key, QUERIES[key], ORACLE[key]) is None
