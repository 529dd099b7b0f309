"""The queries that SQL can express give the same rows as DuckDB, over whole tables."""

import duckdb
import pytest

from sieveworks.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(ORACLES[name])
    assert columns == sorted(want.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall(), key=repr)
