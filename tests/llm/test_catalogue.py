"""The queries of the subpackage: against SQL where there is some, and that every one runs."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from countlake.llm import queries as lq

QUERIES, ORACLE = lq.queries(), lq.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    got = QUERIES[name](spark, data)
    if name not in ORACLE:
        assert got.count() > 0
        return
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = got.toPandas(), c.execute(ORACLE[name]).df()
    cols = sorted(want.columns)
    order = lambda t: t[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)
