"""Queries against their SQL, on the smallest tables; the driver does the same at a larger size."""

from __future__ import annotations

import math

import duckdb
import pytest
from weftline import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    got = catalog.queries()[name](spark, SF)
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    left = [tuple(plain(r[c]) for c in names) for r in got.collect()]
    right = [tuple(map(plain, r)) for r in want.fetchall()]
    assert sorted(left, key=str) == sorted(right, key=str)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_give_the_same_rows_twice(spark, name):
    query = catalog.queries()[name]
    assert sorted(map(str, query(spark, SF).collect())) == sorted(map(str, query(spark, SF).collect()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
