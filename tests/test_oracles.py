"""Every road query with SQL gives the same rows as DuckDB."""

import pytest

from roadweave.queries import QUERIES
from roadweave.sql import ORACLES

from compare import connect, same


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_entry_point():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "remaining_km_by_dir" in entry.queries()
