"""Every core query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from countlake.plans import catalogue

QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, data, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.execute(ORACLE[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    order = lambda t: t[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, atol=1e-9, rtol=0)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry_does_not_need_the_subpackage():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
