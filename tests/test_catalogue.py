"""Every catalogue query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from riskgraph import plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)
    values = df[cols].astype(object).where(df[cols].notna(), None)
    return sorted((tuple(str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in values.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, DATA).toPandas(), duck.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_all_statuses_appear(spark):
    got = {r["status"] for r in plans.QUERIES["C4_triage_summary"](spark, DATA).collect()}
    assert got == {"REACHABLE", "FRONTIER_UNREACHABLE", "NO_FRONTIER", "NOT_IMPORTED"}
