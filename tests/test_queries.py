"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
QUERIES, SQL = driver.QUERIES, driver.ORACLE


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_entry(spark):
    assert driver.entry(spark).columns == ["category", "n_hits", "n_docs"]


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    assert differences(QUERIES[name](spark, SF), db, SQL[name]) == []
