"""The corpus queries that SQL can express, over the smallest tables, and all others' row counts."""

import duckdb
import pytest

from factloom.llm import queries as q

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(q.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = q.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, map(tuple, got.select(names).collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name,table", [("op3_quality", "documents"), ("op6_language", "documents"), ("op6_language_pages", "pages"), ("op7_suffix_dedup", "documents"), ("op8_simhash", "documents"), ("op9_token_counts", "documents")])
def test_one_row_for_each_row(spark, name, table):
    assert q.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
