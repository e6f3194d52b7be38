"""Text queries that DuckDB can answer, on the same small tables."""

import glob

import pytest

from hopflux.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not glob.glob(f"{SF}/documents.parquet"), reason="no test tables")
@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    session = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        session.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), session.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))
