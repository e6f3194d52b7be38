"""Every registered graph query against DuckDB on the same tables."""

import glob
import os

import pytest

from hopflux.queries import ORACLES, QUERIES

SF = os.environ.get("HOPFLUX_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not glob.glob(f"{SF}/lineitem.parquet"), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    session = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        session.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return session


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))


def test_entry_and_registry():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
