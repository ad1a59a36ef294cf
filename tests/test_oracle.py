"""Each registered query against its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from factloom.model import TABLES
from factloom.plans import registry

SF = os.environ.get("FACTLOOM_SF", "/root/testdata/sf0.001")
ORACLE, QUERIES = registry.oracle_sql(), registry.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cells(rows):
    show = lambda x: f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(show, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLE:
        assert got.count() >= 0
        return
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert cells(map(tuple, got.select(*(f"`{n}`" for n in names)).collect())) == cells(want.fetchall())
