import zlib

import numpy as np
import pytest

from factloom.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left_semi")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    held = got[got.held_out]
    good, bad = held[held.quality == 1], held[held.quality == 0]
    rank = held.score.rank()
    auc = (rank[held.quality == 1].sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))
    assert auc > 0.97
    assert (held.predicted == held.quality).mean() > 0.95 and (good.predicted == 1).mean() > 0.98


def test_every_row_has_a_score(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 120, 3)] + [(5, None, 1), (None, 1, 1), (3, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (200, 201, 202)}) == 1
    assert quality.classify(empty, labels).count() == 0
    unlabelled = quality.classify(docs, labels.where("false")).collect()
    assert {r.score for r in unlabelled} == {0.5}


@pytest.mark.parametrize("text", ["", "a", "Ab ab, AB!! $$$\n x", "é ü ß " * 3, "word " * 50])
def test_scores_do_not_depend_on_neighbours(text):
    up, down = quality._powers(4096)
    one = text.encode()
    many = b"before it " + one + b"after"
    alone = quality.features(np.array([0, len(one)]), np.frombuffer(one, np.uint8), up, down)
    among = quality.features(np.array([0, 10, 10 + len(one), len(many)]), np.frombuffer(many, np.uint8), up, down)
    assert sorted(alone[1].tolist()) == sorted(among[1][among[0] == 1].tolist())


def test_updates_follow_the_formula():
    rows = [(1, np.array([0, 2]), np.array([1.0, 0.5])), (0, np.array([1]), np.array([2.0]))]
    z, n = np.zeros(5), np.zeros(5)
    for y, i, x in rows:
        i, x = np.append(i, 4), np.append(x, 1.0)
        w = np.array([0 if abs(z[j]) <= quality.L1 else -(z[j] - np.sign(z[j]) * quality.L1) / ((quality.BETA + n[j] ** 0.5) / quality.ALPHA + quality.L2) for j in i])
        p = 1 / (1 + np.exp(-(w @ x)))
        for j, g, wj in zip(i, (p - y) * x, w):
            z[j] += g - ((n[j] + g * g) ** 0.5 - n[j] ** 0.5) / quality.ALPHA * wj
            n[j] += g * g
    got = quality.ftrl(rows, bits=2, epochs=1)
    want = [0 if abs(a) <= quality.L1 else -(a - np.sign(a) * quality.L1) / ((quality.BETA + b**0.5) / quality.ALPHA + quality.L2) for a, b in zip(z, n)]
    assert np.allclose(got, want)


def test_a_repeated_document_trains_as_one(spark):
    rows = [(i, f"good words {i}" if i % 2 else f"%%% bad {i} %%%") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1)], "doc_id long, quality int")
    hot = docs.unionByName(spark.range(5000).selectExpr("3L as doc_id", "'good words 3' as text")).unionByName(spark.range(50).selectExpr("cast(null as long) as doc_id", "'x' as text"))
    assert (quality.train(docs, labels) == quality.train(hot.repartition(5), labels)).all()
