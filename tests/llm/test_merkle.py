"""Manifests against a plain tree, proofs against folding by hand, tampering, and the exchange's rounds."""

import zlib
from hashlib import sha256
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from factloom.llm import merkle as m


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def path(tree, i, fanout):
    for nodes in tree[:-1]:
        run, k = nodes[i // fanout * fanout : (i // fanout + 1) * fanout], i % fanout
        yield "".join(run[:k]), "".join(run[k + 1 :])
        i //= fanout


def brute(rows, fanout):
    first = lambda v: (v is not None, v or 0)
    made = [(r.source, r.doc_id, leaf(r, r.text), r) for r in rows]
    made.sort(key=lambda x: ((x[0] is not None, (x[0] or "").encode()), first(x[1]), x[2]))
    trees = [(s, list(g)) for s, g in groupby(made, lambda x: x[0])]
    inner = [levels([x[2] for x in g], fanout) for _, g in trees]
    top = levels([t[-1][0] for t in inner], fanout)
    for n, (source, group) in enumerate(trees):
        for i, (_, doc, own, r) in enumerate(group):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
            touched = r.text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
            h, proof = leaf(r, low) if touched else own, ""
            for a, b in [*path(inner[n], i, fanout), *path(top, n, fanout)]:
                proof, h = proof + a + b, digest(a + h + b)
            root = top[-1][0]
            yield doc, own, inner[n][-1][0], root, digest(proof), h, h == root, source, i


@pytest.mark.parametrize("fanout,size", [(16, 3), (3, 1), (2, 2), (3, 0)])
def test_manifest_is_the_plain_tree(nameless, fanout, size):
    rows = nameless.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.upper("text")).otherwise(F.col("text")))
    got = m.manifest(rows, tampered=m.lower_cased(), fanout=fanout, levels=size)
    want = list(brute(rows.collect(), fanout))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert {w[6] for w in want} == {True, False}


def test_tampering_shows_and_nothing_else(spark, nameless):
    rows = nameless.withColumn("text", F.concat("text", F.lit(" Capital")))
    out = m.manifest(rows, tampered=m.lower_cased(), fanout=4, levels=1).collect()
    for x in out:
        assert x.verified == (x.doc_id is None or x.doc_id == 200 or zlib.crc32(str(x.doc_id).encode()) % 5 != 0)
        assert x.verified == (x.folded_root == x.root)
    assert all(x.verified for x in m.manifest(rows, fanout=4, levels=1).collect())
    changed = rows.withColumn("n_chars", F.when(F.col("doc_id") == 5, -1).otherwise(F.col("n_chars")))
    roots = {x.root for x in out} | {m.manifest(changed, fanout=4, levels=1).first().root}
    assert len(roots) == 2


def test_empty_and_single(spark, docs, empty):
    assert m.manifest(empty).count() == 0
    one = m.manifest(docs.where("doc_id = 5")).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == digest("") and one.position == 0


def test_a_hot_tree_over_many_partitions_and_rounds(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 23).cast("string"))).alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.concat(F.lit("T"), F.col("id")).alias("text"))
    got = m.manifest(rows, tampered=m.lower_cased(), fanout=4, levels=2)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows.collect(), 4))


def test_numbering_deals_one_repeated_key_over_ranges(spark):
    rows = spark.range(5000).select(F.lit("a").alias("tree"), F.lit(7).cast("long").alias("id"))
    out = m.numbered(rows, ["tree"], ["id"], "at")
    assert sorted(r.at for r in out.collect()) == list(range(5000))
    ranges = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(ranges) > 1


def test_each_partition_serves_about_fanout_others(spark):
    """Blocks of 8, 8 and 3 partitions: all learn the same root, and the blocks beside their own."""
    state = spark.range(19).selectExpr("id as g", "0L as p", "0L as q", "id div 8 as digit", "concat('r', id div 8) as root")
    out = {r.g: r for r in m.exchange(state).collect()}
    assert len(out) == 19 and {r.root for r in out.values()} == {digest("r0r1r2")}
    assert (out[3].left, out[3].right) == ("", "r1r2") and (out[17].left, out[17].right) == ("r0r1", "")
