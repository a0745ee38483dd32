"""Every registered query against its DuckDB SQL, at the smallest scale."""

from __future__ import annotations

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from framewitness.catalog import queries as catalog
from framewitness.catalog.oracle import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.fixture(scope="module", autouse=True)
def one_investigation(spark):
    """The ledger queries share one investigation, to keep the tests short."""
    build, made = catalog._investigation, []

    def shared(spark, sf):
        if not made:
            made.append(build(spark, sf))
        return made[0]

    catalog._investigation = shared
    yield
    catalog._investigation = build


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(ORACLE)
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_duckdb(spark, connection, name):
    query, sql = entry.queries()[name], entry.oracle_sql()[name]
    assert compare(spark, connection, SF, query, sql) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 11
