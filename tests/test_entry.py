"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

import __spark_entry__ as entry

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import compare  # noqa: E402

from rivulet.plans import CORE_QUERIES, CORE_SQL  # noqa: E402


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck(sf):
    return compare.oracle(sf)


@pytest.mark.parametrize("name", sorted(CORE_QUERIES))
def test_query(spark, sf, duck, name):
    df = CORE_QUERIES[name](spark, sf)
    got = compare.rows(df.columns, df.collect())
    assert got, "a query without rows tests nothing"
    if name in CORE_SQL:
        cur = duck.execute(CORE_SQL[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == compare.rows(columns, cur.fetchall())
