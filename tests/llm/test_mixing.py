import duckdb
import pytest

from factloom.llm import mixing


def cells(rows):
    return sorted(map(str, rows))


def oracle(docs, **constants):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    sql = mixing.ORACLE_SQL
    for old, new in constants.items():
        sql = sql.replace(f"{getattr(mixing, old)}", f"{new}")
    return [tuple(r) for r in con.execute(sql).fetchall()]


@pytest.mark.parametrize("entropy", [mixing.ENTROPY, 0.5])
def test_matches_sql(docs, entropy):
    got = mixing.mixture(docs, entropy=entropy)
    got = got.select("doc_id", "source", "tokens", "epoch", "block", "block_rank").collect()
    assert cells(map(tuple, got)) == cells(oracle(docs, ENTROPY=entropy))


def test_small_blocks_and_repeats(docs):
    got = mixing.mixture(docs, entropy=0.999, block_tokens=300)
    got = got.select("doc_id", "source", "tokens", "epoch", "block", "block_rank").collect()
    assert cells(map(tuple, got)) == cells(oracle(docs, ENTROPY=0.999, BLOCK_TOKENS=300))


def test_rare_sources_repeat_no_more_than_asked(spark):
    words = "w " * 50
    rows = [(i, words, "big") for i in range(400)] + [(1000 + i, words, "rare") for i in range(4)] + [(2000, words, None), (2001, None, "none"), (2002, "", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(docs, entropy=1.0, repeats=3.0).toPandas()
    per = got.groupby("doc_id").size()
    assert per.max() <= 4 and got[got.source == "rare"].tokens.sum() <= 3 * 4 * 50 * 1.01
    assert 2001 not in per.index and got.tokens.sum() <= 405 * 50
    even = mixing.mixture(docs, entropy=0.0, repeats=1.0).toPandas()
    assert sorted(even.doc_id) == sorted(r[0] for r in rows if r[0] != 2001)


def test_mix_keeps_columns_and_empty_tables(docs, empty):
    assert mixing.mix(docs).columns == [c for c in docs.columns if c not in mixing.ADDED] + list(mixing.ADDED)
    assert mixing.mixture(empty).count() == 0
