"""Registered queries against their DuckDB statements, on whole tables."""

import duckdb
import pytest

from contactloom import ship
from contactloom.llm.entries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](ship(spark), SF)
    cols = sorted(df.columns)
    want = con.execute(ORACLE[name]).df()
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(map(tuple, want[cols].values.tolist()))
