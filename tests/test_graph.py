"""Strongly connected components against the closure, on rings, chains and random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import graph as g


def brute(edges):
    out = {}
    for f, t in edges:
        out.setdefault(f, set()).add(t)
    reach = {}
    for n in out:
        seen, todo = set(), list(out[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        reach[n] = seen
    return {n: min(m for m in reach[n] if n in reach.get(m, ())) for n in reach if n in reach[n]}


def table(spark, edges):
    return spark.createDataFrame([(str(a), str(b)) for a, b in edges] + [("z", None), (None, "z")], "f string, t string")


def made(seed):
    rng = random.Random(seed)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range([40, 70, 110, 200][seed % 4])]
    edges += [(100 + i, 100 + (i + 1) % 17) for i in range(17)] + [(200 + i, 201 + i) for i in range(15)] + [(205, 105), (110, 3), (3, 205), (300, 300), (301, 302)]
    return edges + [(400 + i, 400 + (i * 7 + 1) % 11) for i in range(11)] + [(400 + i, 400 + (i * 3 + 2) % 11) for i in range(11)]


@pytest.mark.parametrize("seed", range(4))
def test_cycles_are_those_of_the_closure(spark, seed):
    edges = made(seed)
    got = {r.node: r.cycle for r in g.on_cycles(table(spark, edges)).collect()}
    assert got == brute([(str(a), str(b)) for a, b in edges])


def test_no_cycles_and_no_edges(spark):
    chain = table(spark, [(i, i + 1) for i in range(30)])
    assert g.on_cycles(chain).count() == 0 and g.on_cycles(chain.limit(0)).count() == 0
    assert [tuple(r) for r in g.on_cycles(table(spark, [(5, 5), (5, 6)])).collect()] == [("5", "5")]


def test_colouring_alone(spark):
    edges = [(str(a), str(b)) for a, b in made(2)]
    e = spark.createDataFrame([(a, b) for a, b in set(edges) if a != b], "f string, t string")
    got = {}
    for r in g._coloured(g._trimmed(e)).collect():
        got.setdefault(r.component, set()).add(r.node)
    want = {}
    for node, c in brute([(a, b) for a, b in edges if a != b]).items():
        want.setdefault(c, set()).add(node)
    assert sorted(map(sorted, (x for x in got.values() if len(x) > 1))) == sorted(map(sorted, want.values()))


def test_a_long_ring_stores_edges_and_not_pairs(spark, monkeypatch):
    n, stored = 100_000, []
    whole = g.checkpointed

    def counted(df):
        out = whole(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(g, "checkpointed", counted)
    ring = spark.range(n).select(F.col("id").cast("string").alias("f"), ((F.col("id") + 1) % n).cast("string").alias("t"))
    out = g.on_cycles(ring.unionByName(spark.range(50).selectExpr("concat('in', id) as f", "cast(id * 7 as string) as t")))
    assert tuple(out.agg(F.count("*"), F.min("cycle"), F.max("cycle")).first()) == (n, "0", "0")
    assert max(stored) <= n + 50 and len(stored) < 130 and sum(stored) < 40 * n
