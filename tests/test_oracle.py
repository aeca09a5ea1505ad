"""Every registered query equals its SQL on the smallest driver tables."""

from __future__ import annotations

import pytest
from conftest import DATA
from oracle import compare, duck

from ledgerloom.suite import QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    q = QUERIES[name]
    df = q.build(spark, DATA)
    if q.sql is None:
        assert df.count() >= 0
    else:
        assert compare(df, con, q.sql) is None


def test_entry_file(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
