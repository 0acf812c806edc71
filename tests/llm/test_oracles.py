"""The queries that SQL can express, on the smallest tables."""

import duckdb
import pytest

from mediagrove.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duck.execute(Q.SQL[name])
    columns = [d[0] for d in want.description]
    got = Q.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(map(str, r)) for r in got.select(columns).collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())
