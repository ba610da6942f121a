"""Every registered query against its checking SQL on the smallest data folder."""

from __future__ import annotations

import pytest
from compare import connect, first_difference, spark_rows, sql_rows

import __spark_entry__ as registered
from shelfmark.plans.catalog_queries import QUERIES
from shelfmark.plans.oracle import ORACLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(registered.queries())


def test_entry(spark):
    rows = registered.entry(spark).collect()
    assert {row["provider"] for row in rows} >= {"openneuro", "osf", "zenodo", "other"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, database, name):
    difference = first_difference(
        spark_rows(registered.queries()[name](spark, FOLDER)), sql_rows(database, registered.oracle_sql()[name])
    )
    assert difference is None, difference
