"""Every registered query against its DuckDB twin on the same tables."""

import pytest

import __spark_entry__ as driver
from tests.compare import difference, open_tables

QUERIES = driver.queries()
ORACLES = driver.oracle_sql()
#: Queries whose rows depend on a rare case that the smallest tables do not hold.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con(sf_dir):
    return open_tables(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        found = difference(df, con, ORACLES[name])
        assert found is None or (found == "empty result" and name in MAY_BE_EMPTY), found
    else:
        assert df.count() > 0


def test_entry(spark):
    assert {r["model_tag"] for r in driver.entry(spark).collect()}


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
