import glob
import os

import duckdb
import pytest

from keytide.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, db, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), db.sql(catalogue.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for c in cols:
        a, b = got[c], want[c]
        if "float" in f"{a.dtype}{b.dtype}":
            assert (a.isna() == b.isna()).all() and ((a.astype(float) - b.astype(float)).abs().fillna(0) < 1e-9).all(), c
        else:
            assert a.astype(str).tolist() == b.astype(str).tolist(), c


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 15
    assert set(e.oracle_sql()) <= set(e.queries())
