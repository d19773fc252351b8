"""Every training-data query against its SQL over the smallest tables."""

import glob
import os

import pytest

from quirespark.llm import queries as Q

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = Q.queries()[name](spark, DIR)
    rows = df.collect()
    sql = Q.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for f in glob.glob(DIR + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    r = con.execute(sql)
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    rounded = lambda v: round(v, 5) if isinstance(v, float) else v
    assert sorted(repr(tuple(rounded(x[c]) for c in sorted(cols))) for x in rows) == sorted(repr(tuple(rounded(x[cols.index(c)]) for c in sorted(cols))) for x in r.fetchall())
