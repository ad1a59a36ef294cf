"""Quality scores: logistic regression over hashed word n-grams, trained by follow-the-regularised-
leader (proximal) updates and scored as a sparse dot product.

A token is a run of letters and digits or a run of other signs. Features are token and token-pair
hashes, and the same over token shapes (kind, capitals, length, equal to the token before), each
with its share of the document's tokens as value, so a score is a mean of weights over tokens.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, text_chunks

#: Weights, as a power of two. The model is broadcast; its size is fixed.
BITS = 18
#: At most so many labelled rows, those of the smallest hash, train the model.
TRAIN_ROWS = 6_000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-3
#: Shares are small numbers; the model sees them times this.
SCALE = 40.0
THRESHOLD = 0.3

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = mixed(np.arange(1001, 1257, dtype=np.uint64))
_KIND = np.array([0 if b in b" \t\n\r\v\f" else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.int8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_UPPER = np.array([65 <= b <= 90 for b in range(256)], bool)


def features(offsets: np.ndarray, data: np.ndarray, up: np.ndarray, down: np.ndarray):
    """For some whole texts: each token feature's document index and hashed index."""
    n = len(data)
    kind = _KIND[data]
    cut = np.ones(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    cut[offsets[:-1][offsets[:-1] < n]] = True
    edges = np.flatnonzero(cut)
    start, end = edges[:-1], edges[1:]
    real = kind[start] > 0
    start, end = start[real], end[real]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[_LOWER[data]] * up[:n], out=sums[1:])
    caps = np.zeros(n + 1, np.int64)
    np.cumsum(_UPPER[data], out=caps[1:])
    doc = np.searchsorted(offsets, start, "right") - 1
    word = mixed((sums[end] - sums[start]) * down[start])
    head = np.r_[True, doc[1:] != doc[:-1]]
    before = np.where(head, np.uint64(1), np.r_[np.uint64(1), word[:-1]])
    length, capital = end - start, caps[end] - caps[start]
    shape = kind[start].astype(np.uint64)
    shape = shape * np.uint64(4) + np.where(capital == 0, 0, np.where(capital == length, 2, 1)).astype(np.uint64)
    shape = shape * np.uint64(8) + np.minimum(length, 7).astype(np.uint64)
    shape = shape * np.uint64(2) + (word == before).astype(np.uint64)
    shape_before = np.where(head, np.uint64(0), np.r_[np.uint64(0), shape[:-1]])
    pair = lambda a, b, salt: mixed(mixed(a + np.uint64(salt)) * np.uint64(31) + b)
    all_ = [word, pair(before, word, 3), mixed(shape + np.uint64(5 << 40)), pair(shape_before, shape, 7 << 40)]
    index = np.concatenate([(x >> np.uint64(64 - BITS)).astype(np.int64) for x in all_])
    return np.tile(doc, len(all_)), index, np.bincount(doc, minlength=len(offsets) - 1)


def _powers(n: int):
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out


def _featured(batches):
    """(rank, label, indices, values) of labelled rows."""
    import pyarrow as pa

    up, down = _powers(1 << 20)
    for batch in batches:
        index, value = [], []
        for _, offsets, data in text_chunks(batch.column(2), 1 << 19):
            if len(data) >= len(up):
                up, down = _powers(2 * len(data))
            doc, idx, tokens = features(offsets, data, up, down)
            key, count = np.unique(doc << BITS | idx, return_counts=True)
            at = np.searchsorted(key, np.arange(len(offsets)) << BITS)
            for i in range(len(offsets) - 1):
                part = slice(at[i], at[i + 1])
                index.append(key[part] & ((1 << BITS) - 1))
                value.append((SCALE * count[part] / max(tokens[i], 1)).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(index, pa.list_(pa.int64())), pa.array(value, pa.list_(pa.float32()))],
            names=["rank", "label", "indices", "values"],
        )


def ftrl(rows, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the last of them the bias, from (label, indices, values) rows in order."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for label, index, value in rows:
            i, x = np.append(index, 1 << bits), np.append(value, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(np.arange(len(z)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learnt from at most max_rows labelled documents, those of the smallest hash of
    doc_id. Null labels are left out; each row of a repeated label counts, with one text, the smallest,
    of a repeated document; without any label the weights are zero. One task trains; its input is bounded by max_rows."""
    import pandas as pd

    rank = F.xxhash64("doc_id", F.lit(3))
    sample = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    sample = sample.select("doc_id", F.col(label).cast("int").alias("label"), rank.alias("rank"))
    sample = sample.orderBy("rank", "doc_id", "label").limit(max_rows)
    # One text for each sampled document, however often its id comes, so that the task's input is bounded.
    asked = F.broadcast(sample.select("doc_id").distinct())
    texts = docs.select("doc_id", "text").join(asked, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = texts.join(F.broadcast(sample), "doc_id").select("rank", "label", "text")
    rows = texts.mapInArrow(_featured, "rank long, label int, indices array<long>, values array<float>")

    def fit(pdf):
        pdf = pdf.sort_values(["rank", "label"], kind="stable")
        w = ftrl(list(zip(pdf["label"], pdf["indices"], pdf["values"], strict=True)))
        return pd.DataFrame({"weights": [w.astype(np.float32)]})

    model = rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(fit, "weights array<float>").first()
    return np.zeros((1 << BITS) + 1, np.float32) if model is None else np.array(model.weights, np.float32)


def _scores(weights: np.ndarray):
    def run(batches):
        import pyarrow as pa

        up, down = _powers(1 << 20)
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for i, offsets, data in text_chunks(batch.column(batch.num_columns - 1), 1 << 19):
                if len(data) >= len(up):
                    up, down = _powers(2 * len(data))
                doc, idx, tokens = features(offsets, data, up, down)
                total = np.bincount(doc, weights[idx], len(offsets) - 1) if len(doc) else np.zeros(len(offsets) - 1)
                x = weights[-1] + SCALE * total / np.maximum(tokens, 1)
                score[i : i + len(x)] = 1 / (1 + np.exp(-np.clip(x, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score): one row for each row of docs; the score reads the text alone. A null or
    empty text has the bias's score; repeated rows stay; an empty table gives no rows."""
    return docs.select("doc_id", "text").mapInArrow(_scores(weights), "doc_id long, score double")


def held_out(doc_id) -> F.Column:
    """Whether a document's label is never learnt from; so are those without an id."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; labels of held-out documents are
    never read."""
    weights = train(docs, labels.where(~held_out("doc_id")), max_rows=max_rows)
    return score(docs, weights).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
