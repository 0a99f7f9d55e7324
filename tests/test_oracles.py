import duckdb
import glob
import os

import pandas as pd
import pytest

from tideline.plans import audit_queries, record_queries, run_queries, source_queries, value_queries  # noqa: F401
from tideline.plans.oracles import ORACLES as BASE
from tideline.plans.queries import QUERIES as FIRST

QUERIES, ORACLES = FIRST | record_queries.QUERIES, BASE | record_queries.ORACLES

DATA = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(con.sql(ORACLES[name]).df())
