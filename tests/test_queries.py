"""Every registered query of the engine against its SQL at the smallest scale."""

import math
import os

import duckdb
import pandas as pd
import pytest

from fathomline.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def rows(frame: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "~"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sql, name):
    got = plans.queries()[name](spark, SF).toPandas()
    want = plans.oracle_sql().get(name)
    if want is None:
        assert len(got)
        return
    want = sql.sql(want).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
