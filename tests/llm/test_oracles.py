import os

import duckdb
import pytest

from keytide.llm import queries

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("benchmark", "documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for c in cols:
        if got[c].isna().any() and "float" in f"{got[c].dtype}{want[c].dtype}":  # whole numbers with nulls
            got[c], want[c] = (x[c].astype("Int64") for x in (got, want))
        assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c
