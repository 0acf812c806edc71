"""Every catalog query against its oracle on the smallest tables."""

import functools
import glob
import os

import duckdb
import pytest

from mediagrove.plans import document_queries, more_queries, stream_queries, table_queries, view_queries  # noqa: F401  register their queries
from mediagrove.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.fixture(scope="module", autouse=True)
def one_catalog():
    """The catalog's tables are written once for all queries that read them."""
    patch = pytest.MonkeyPatch()
    once = functools.cache(Q._catalog)
    for module in (Q, view_queries):
        patch.setattr(module, "_catalog", once)
    yield
    patch.undo()


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    want = duck.execute(Q.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(tuple(map(str, r)) for r in got.select(columns).collect())
    assert rows == sorted(tuple(map(str, r)) for r in want.fetchall())


def test_every_query_has_an_oracle():
    assert set(Q.QUERIES) == set(Q.SQL)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_oracle_gives_rows(name):
    c = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.01/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert c.execute(Q.SQL[name]).fetchone() is not None
