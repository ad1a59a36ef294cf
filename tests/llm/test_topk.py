import numpy as np
import pytest

from factloom.llm import topk


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        all_ = sorted((-int(np.dot(v.astype(object), w.astype(object))), i) for i, w in rows if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(all_[:k])]
    return sorted(out)


@pytest.mark.parametrize("dims,high,n", [(3, 3, 200), (8, 40, 150), (2, 10**9, 60), (4, 0, 30), (40, 5, 7)])
def test_matches_brute_force(spark, dims, high, n):
    rng = np.random.default_rng(dims)
    rows = [(i, rng.integers(-high, high + 1, dims)) for i in range(n)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, v array<long>")
    queries = [r for r in rows if r[0] % 7 == 0]
    got = topk.top_k(df, df.where("vec_id % 7 = 0"), 20, block_rows=50, query_rows=9).collect()
    assert sorted(map(tuple, got)) == brute(rows, queries, 20)


def test_stops_before_it_has_scored_all():
    rng = np.random.default_rng(1)
    rows = rng.normal(0, 100, (4000, 2)).astype(np.int64).astype(np.float64)
    lists = topk.Lists(np.arange(4000), rows)
    depths = np.array([5, 20, 80, 320, 1280, 4000])
    q = np.array([3.0, 2.0])
    ids, scores, n = lists.top(q, -1, 5, depths, lists.bounds(q[None], depths)[0])
    assert n < 2000 and scores.tolist() == sorted((rows @ q).tolist(), reverse=True)[:5]


def test_bad_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [1.0, -inf]), (5, [-0.01, 3.0]), (0, [1.0, 2.0]), (6, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.vectors(df)
    assert {r.vec_id: r.v for r in v.collect()} == {0: [64, 128], 5: [-1, 192], 6: [64]}
    got = [tuple(r) for r in topk.top_k(v, v.where("vec_id = 0")).collect()]
    assert sorted(got) == [(0, 1, 5, 24512), (0, 2, 6, 4096)]
    none = v.where("vec_id < 0")
    assert topk.top_k(none, none).count() == 0 and topk.top_k(v, none).count() == 0
