"""Every query with SQL against DuckDB at the smallest scale, and the others by their columns."""

import os

import duckdb
import pandas as pd
import pytest

from occuspan import registry

DIR = "/root/testdata/sf0.001"
Q, S = registry.queries(), registry.oracles()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list):
            return str([cell(x) for x in v])
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.8g}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return con


def test_every_oracle_has_a_query():
    assert set(S) <= set(Q)


@pytest.mark.parametrize("name", sorted(S))
def test_same_rows_as_sql(spark, duck, name):
    got, want = Q[name](spark, DIR).toPandas(), duck.sql(S[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
