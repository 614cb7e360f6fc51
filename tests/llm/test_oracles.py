"""Queries with SQL give the SQL's rows."""

import duckdb
import pytest

from quillspark.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    at = [names.index(c) for c in columns]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == theirs and theirs
