"""Every query of the package against its SQL on the smallest tables, or that it runs."""

import os
import sys

import pytest
from pyspark.sql import functions as F

from rivulet.llm import queries
from rivulet.llm.queries import QUERIES, SQL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
import compare  # noqa: E402


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    got = compare.rows(df.columns, df.collect())
    assert got
    if name in SQL:
        cur = compare.oracle(sf).execute(SQL[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns) and got == compare.rows(columns, cur.fetchall())


def test_short_segments_count_when_sure(spark):
    rows = [("es", 0.95, 3), ("es", 0.6, 3), ("es", 0.6, 4), ("es", 0.5, 9), ("und", 0.99, 3), ("es", 0.9, 2)]
    df = spark.createDataFrame([(r,) for r in rows], "s struct<language:string,confidence:double,words:int>")
    assert [r[0] for r in df.select(queries._stands(F.col("s"))).collect()] == [True, False, True, False, False, True]
