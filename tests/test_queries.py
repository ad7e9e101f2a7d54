"""Every registered query against SQL on the same tables."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from webcorpus.plans.registry import QUERIES


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


def test_every_query_has_a_check():
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, sf, name):
    assert compare(spark, db, sf, name) == ""


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"page_type", "restricted", "n_pages", "n_routes"} == set(rows[0].asDict())
