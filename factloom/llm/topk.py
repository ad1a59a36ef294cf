"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are dealt into blocks, and a block keeps one sorted list for each dimension. A query goes
down all lists in step, from the end that its sign favours, scores each vector when it first meets
it, and stops when the best that an unseen vector could have, the inner product with the values now
at hand, is below its k-th score. Queries and vectors meet block by block; each meeting gives k rows
for a query, and those are ranked last.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 20
BLOCK_ROWS = 8_192
QUERY_ROWS = 2_048


class Lists:
    """The sorted lists of one block: ids ascending, rows of numbers that are whole."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.order = np.argsort(-self.rows, axis=0, kind="stable")
        self.values = np.take_along_axis(self.rows, self.order, 0)

    def bounds(self, queries: np.ndarray, depths: np.ndarray) -> np.ndarray:
        """What an unseen vector can score at most after so many steps, queries by depths."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ self.values[depths - 1].T + down @ self.values[len(self.ids) - depths].T

    def top(self, query: np.ndarray, own: int, k: int, depths: np.ndarray, bounds: np.ndarray):
        """Ids and scores of the k best of this block but own; also how many were scored."""
        n = len(self.ids)
        seen, had = np.zeros(n, bool), np.zeros(n, bool)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        met, scores, at, best = np.zeros(0, np.int64), np.zeros(0, self.rows.dtype), 0, -np.inf
        for depth, bound in zip(depths.tolist(), bounds, strict=True):
            seen[self.order[at:depth, up]] = True
            seen[self.order[n - depth : n - at, down]] = True
            if depth == n:
                seen[:] = True  # a query of zeros has no list
            fresh = np.flatnonzero(seen & ~had)
            # Many at once are scored in one sweep over the rows that the block holds anyway.
            own_scores = (self.rows @ query)[fresh] if 2 * len(fresh) > n else self.rows[fresh] @ query
            fine = self.ids[fresh] != own
            met, scores = np.concatenate([met, fresh[fine]]), np.concatenate([scores, own_scores[fine]])
            at, had = depth, seen.copy()
            if len(met) >= k:
                best = np.partition(scores, -k)[-k]
                met, scores = met[scores >= best], scores[scores >= best]
            if bound < best or had.all():
                break
        order = np.lexsort((self.ids[met], -scores))[:k]
        return self.ids[met[order]], scores[order], int(had.sum())


def whole_rows(column, dims: int) -> np.ndarray:
    """Lists of whole numbers as one array; shorter ones are filled with zeros. Numbers are held as
    floats while every inner product is exact in them."""
    rows = np.zeros((len(column), dims), np.int64)
    for i, x in enumerate(column):
        rows[i, : len(x)] = x
    return rows


def _meet(k: int):
    def run(key, left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        dims = max(left["v"].map(len).max(), right["v"].map(len).max())
        rows, queries = whole_rows(left["v"], dims), whole_rows(right["v"], dims)
        most = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(dims, 1)
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
        lists = Lists(left["vec_id"].to_numpy(), rows.astype(kind))
        queries, n = queries.astype(kind), len(left)
        depths = np.unique(np.minimum(n, [n] + [k << 2 * s for s in range(n.bit_length())]))
        bounds = lists.bounds(queries, depths)
        out = []
        for i, own in enumerate(right["vec_id"].tolist()):
            ids, scores, _ = lists.top(queries[i], own, k, depths, bounds[i])
            out.append((np.full(len(ids), own), ids, scores.astype(np.int64)))
        q, v, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    return run


def vectors(embeddings: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, v) with components floor(scale * x). Vectors that are null or hold a null or
    non-finite component are left out; repeated rows count once."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = embeddings.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(fine)
    return rows.select(F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v")).distinct()


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k vectors of rows with the
    highest inner product, all if fewer, ties to the smaller vec_id, itself left out. Both have
    (vec_id, v). Empty tables give no rows; vectors of unequal length are filled with zeros."""
    blocks = max(1, -(-rows.count() // block_rows))
    groups = max(1, -(-queries.count() // query_rows))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("vec_id", "v", part(blocks).alias("b"), every(groups).alias("g"))
    right = queries.select("vec_id", "v", every(blocks).alias("b"), part(groups).alias("g"))
    met = left.groupBy("b", "g").cogroup(right.groupBy("b", "g"))
    met = met.applyInPandas(_meet(k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
