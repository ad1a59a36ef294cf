"""A Merkle manifest of a table, with an inclusion proof for each row, by butterfly exchange.

Leaves are dealt, in the order of their tree, into aligned partitions of fanout^3. Each partition
hashes its own subtree. Then, round by round, the partitions of a group of fanout aligned blocks
swap block roots: a partition asks one partition of each block, the one at its own place there, so
that all serve about fanout others, and every partition hashes the parent for itself. After the last
round each partition holds the siblings of its whole path to the root, though nothing was sent back
down. The last rounds swap between trees: blocks are then runs of trees in their order.

What travels is a digest for each leaf, and fanout digests for each partition and round.
"""

from __future__ import annotations

from functools import cache
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, stored

FANOUT = 16
#: The levels that a partition hashes by itself.
LEVELS = 3
#: Counts and block lists are broadcast up to so many rows, and joined by key beyond.
BROADCAST_ROWS = 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DIGEST = 64
_PATH = "array<struct<level:int,left:string,right:string>>"


def leaf(values: list[Column]) -> Column:
    """The digest of a row: each value as `-` if null, else its UTF-8 byte count, `:` and itself."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def numbered(rows: DataFrame, group: list[str], order: list[str], at: str) -> DataFrame:
    """(rows.*, at): each row's place, from 0, within its group in the given order, nulls first and
    ties in any order. Rows are dealt by range, equal ones apart too, and a range learns from the
    counts of the others what lies before it; no group is gathered."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keys = [F.asc_nulls_first(c) for c in [*group, *order]] + [F.asc("_salt")]
    dealt = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(n, *keys)
    dealt = dealt.sortWithinPartitions(*keys).drop("_salt")
    dealt = dealt.withColumns({"_row": F.monotonically_increasing_id(), "_range": F.spark_partition_id()})
    dealt = stored(dealt, "ranges")
    counts = dealt.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    earlier = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first"))
    counts = small(stored(counts.drop("_n", "_first"), "counts"), BROADCAST_ROWS)
    same = dealt["_range"] == counts["_range"]
    for c in group:
        same = same & dealt[c].eqNullSafe(counts[c])
    place = (counts["_before"] + dealt["_row"]).alias(at)
    return dealt.join(counts, same).select(*[dealt[c] for c in rows.columns], place)


def subtree(leaves: list[bytes], fanout: int, levels: int | None) -> list[list[bytes]]:
    """A subtree's levels, leaves first: so many, or as many as lead to one node."""
    out = [leaves]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([_digest(b"".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return out


def _digest(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def _leaves(pdf, fanout: int, levels: int) -> list[list[bytes]]:
    leaves = [x.encode() for x in pdf["leaf"]]
    return subtree(leaves, fanout, levels if pdf["cells"].iloc[0] > 1 else None)


def _cell_root(fanout: int, levels: int):
    import pandas as pd

    def run(key, pdf):
        root = _leaves(pdf.sort_values("at"), fanout, levels)[-1][0].decode()
        return pd.DataFrame({"t": [key[0]], "cell": [key[1]], "root": [root]})

    return run


def exchange(state: DataFrame) -> DataFrame:
    """One round. state: a row for each partition with its number g, the group (p, q) it swaps in,
    its block's digit in the group and the block's root; a block's partitions have consecutive
    numbers. Returns what each then knows: (g, left, right, root), the digests of the blocks before
    and after its own, joined, and the root of the group."""
    blocks = state.groupBy("p", "q", "digit").agg(F.min("g").alias("lo"), F.count(F.lit(1)).alias("size"))
    blocks = small(stored(blocks, "blocks"), BROADCAST_ROWS)
    mine = state.join(blocks, ["p", "q", "digit"]).select("g", "p", "q", F.col("digit").alias("own"), (F.col("g") - F.col("lo")).alias("place"))
    asked = mine.join(blocks, ["p", "q"]).select("g", "own", "digit", (F.col("lo") + F.col("place") % F.col("size")).alias("partner"))
    told = asked.join(state.select(F.col("g").alias("partner"), "root"), "partner")
    heard = lambda c: F.collect_list(F.when(c, F.struct("digit", "root")))  # noqa: E731  at most fanout
    text = lambda c: F.concat_ws("", F.transform(F.array_sort(heard(c)), lambda x: x["root"]))
    got = told.groupBy("g").agg(
        text(F.col("digit") < F.col("own")).alias("left"),
        text(F.col("digit") > F.col("own")).alias("right"),
        text(F.lit(True)).alias("all"),
    )
    return got.select("g", "left", "right", F.sha2(F.col("all").cast("binary"), 256).alias("root"))


def _paths(cells: DataFrame, fanout: int) -> DataFrame:
    """(t, cell, subroot, root, path) from (g, t, cell, cells, root): rounds within trees until the
    largest is done, then rounds over trees. path: (level, left, right) in order."""
    size = cells.agg(F.max("cells"), F.max("t")).first()
    most, trees = size[0] or 0, -1 if size[1] is None else size[1]
    state, known, level = cells, None, 0

    def swap(active: Column, p: Column, number: str, width: int):
        nonlocal state, known, level
        taking = state.where(active).select(
            "g", p.alias("p"), F.expr(f"{number} div {fanout * width}").alias("q"), F.expr(f"{number} div {width} % {fanout}").alias("digit"), "root"
        )
        heard = stored(exchange(taking), "heard")
        step = heard.select("g", F.lit(level).alias("level"), "left", "right")
        known = step if known is None else known.unionByName(step)
        new = state.join(heard.select("g", F.col("root").alias("new")), "g", "left")
        state = stored(new.withColumn("root", F.coalesce("new", "root")).drop("new"), "state")
        level += 1

    width = 1
    while width < most:
        swap(F.col("cells") > width, F.col("t"), "cell", width)
        width *= fanout
    subroots = state.select("g", F.col("root").alias("subroot"))
    width = 1
    while width <= trees:
        swap(F.lit(True), F.lit(-1).cast("long"), "t", width)
        width *= fanout
    out = state.join(subroots, "g").select("g", "t", "cell", "subroot", "root")
    if known is None:
        return out.withColumn("path", F.expr(f"cast(array() as {_PATH})"))
    steps = known.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("level", "left", "right"))).alias("path"))
    return out.join(steps, "g", "left").withColumn("path", F.coalesce("path", F.expr(f"cast(array() as {_PATH})")))


def _proofs(fanout: int, levels: int):
    import pandas as pd

    def run(key, pdf, upper):
        if not len(pdf):
            return pd.DataFrame({"leaf": []})
        top = upper.iloc[0]
        above = [(s["left"].encode(), s["right"].encode()) for s in top["path"]]
        tail = b"".join(left + right for left, right in above)
        pdf = pdf.sort_values("at")
        up = _leaves(pdf, fanout, levels)
        runs = [[b"".join(x[i : i + fanout]) for i in range(0, len(x), fanout)] for x in up[:-1]]

        @cache  # one partition's leaves mostly lead to one digest
        def folded(h: bytes) -> str:
            for left, right in above:
                h = _digest(left + h + right)
            return h.decode()

        proofs, roots = [], []
        for i, (own, other) in enumerate(zip(up[0], pdf["tampered"], strict=True)):
            h, parts, node = other.encode() if isinstance(other, str) else own, [], i
            for level in runs:
                run, k = level[node // fanout], _DIGEST * (node % fanout)
                left, right = run[:k], run[k + _DIGEST :]
                parts += [left, right]
                h = _digest(left + h + right)
                node //= fanout
            proofs.append(sha256(b"".join(parts) + tail).hexdigest())
            roots.append(folded(h))
        out = pdf[["id", "tree", "leaf", "at"]].assign(subroot=top["subroot"], root=top["root"])
        return out.assign(proof_sha256=proofs, folded_root=roots, verified=[r == top["root"] for r in roots])

    return run


def manifest(
    rows: DataFrame, fields: tuple[str, ...] = FIELDS, id_: str = "doc_id", tree: str = "source",
    tampered: tuple[Column, dict[str, Column]] | None = None, fanout: int = FANOUT, levels: int = LEVELS,
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified, tree, position): one row for
    each row of rows. A tree for each value of `tree` has its leaves by ascending id, rows without
    one first, rows of one id by digest; trees follow by value, null first. Every fanout consecutive
    nodes become the digest of theirs joined, the last ones if fewer, until one remains; a lone leaf
    is its tree's root. proof_sha256 is the digest of all siblings, level by level. folded_root is
    the root recomputed from the leaf, or, where the condition of tampered holds, from the row with
    the fields it replaces, and the siblings. Repeated rows are leaves of their own; columns beyond
    fields are ignored; an empty table gives no rows."""
    given = [F.col(f) for f in fields]
    broken = F.lit(None).cast("string")
    if tampered is not None:
        condition, other = tampered
        broken = F.when(condition, leaf([other.get(f, F.col(f)) for f in fields]))
    leaves = stored(rows.select(F.col(tree).cast("string").alias("tree"), F.col(id_).cast("long").alias("id"), leaf(given).alias("leaf"), broken.alias("tampered")), "leaves")
    placed = numbered(leaves, ["tree"], ["id", "leaf"], "at")
    width = fanout**levels
    trees = placed.groupBy("tree").agg(F.expr(f"(count(1) + {width - 1}) div {width}").alias("cells"))
    trees = stored(numbered(stored(trees, "trees"), [], ["tree"], "t"), "trees")
    side = small(trees, BROADCAST_ROWS)
    dealt = placed.join(side, placed["tree"].eqNullSafe(side["tree"])).select(placed["*"], "t", "cells", F.expr(f"at div {width}").alias("cell"))
    roots = dealt.groupBy("t", "cell").applyInPandas(_cell_root(fanout, levels), "t long, cell long, root string")
    cells = stored(roots.join(side.select("t", "cells"), "t"), "cells")
    upper = _paths(stored(numbered(cells, [], ["t", "cell"], "g"), "cells"), fanout)
    out = dealt.groupBy("t", "cell").cogroup(upper.groupBy("t", "cell")).applyInPandas(
        _proofs(fanout, levels),
        "id long, tree string, leaf string, at long, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    )
    return out.select(F.col("id").alias(id_), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", F.col("tree").alias(tree), F.col("at").alias("position"))


def lower_cased(id_: str = "doc_id", text: str = "text") -> tuple[Column, dict[str, Column]]:
    """Tampering with a fifth of the rows, chosen by their ids: A-Z of the text become a-z."""
    return F.crc32(F.col(id_).cast("string").cast("binary")) % 5 == 0, {text: F.translate(text, _CAPITALS, _SMALL)}



#: The manifest of `documents` for DuckDB, tampered with as in lower_cased.
ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, CAST(dense_rank() OVER (ORDER BY source NULLS FIRST) AS BIGINT) - 1 AS t,
    translate(text, '{_CAPITALS}', '{_SMALL}') AS low,
    list_reduce([4294967295] || list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i, 1))),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM documents
), l AS (
  SELECT doc_id, source, t, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(front || coalesce(strlen(low) || ':' || low, '-')) END AS tampered
  FROM (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS front FROM d)
), p AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS position FROM l
), tree AS (
  SELECT t, 0 AS level, list(leaf ORDER BY position) AS nodes FROM p GROUP BY t
  UNION ALL
  SELECT t, level + 1, list_transform(range(0, (len(nodes) + 15) // 16), lambda i: sha256(list_aggregate(nodes[i * 16 + 1 : i * 16 + 16], 'string_agg', '')))
  FROM tree WHERE len(nodes) > 1
), top AS (
  SELECT 0 AS level, list(nodes[1] ORDER BY t) AS nodes FROM tree WHERE len(nodes) = 1
  UNION ALL
  SELECT level + 1, list_transform(range(0, (len(nodes) + 15) // 16), lambda i: sha256(list_aggregate(nodes[i * 16 + 1 : i * 16 + 16], 'string_agg', '')))
  FROM top WHERE len(nodes) > 1
), inside AS (
  SELECT p.*, 0 AS level, position AS node, coalesce(tampered, leaf) AS h, '' AS proof FROM p
  UNION ALL
  SELECT doc_id, source, t, leaf, tampered, position, level + 1, node // 16, sha256(a || h || b), proof || a || b
  FROM (SELECT f.*, coalesce(list_aggregate(r[1 : node % 16], 'string_agg', ''), '') AS a, coalesce(list_aggregate(r[node % 16 + 2 : 16], 'string_agg', ''), '') AS b
    FROM (SELECT i.*, nodes[node // 16 * 16 + 1 : node // 16 * 16 + 16] AS r FROM inside i JOIN tree USING (t, level) WHERE len(nodes) > 1) f)
), above AS (
  SELECT i.doc_id, i.source, i.leaf, i.position, nodes[1] AS subroot, 0 AS level, i.t AS node, i.h, i.proof FROM inside i JOIN tree USING (t, level) WHERE len(nodes) = 1
  UNION ALL
  SELECT doc_id, source, leaf, position, subroot, level + 1, node // 16, sha256(a || h || b), proof || a || b
  FROM (SELECT f.*, coalesce(list_aggregate(r[1 : node % 16], 'string_agg', ''), '') AS a, coalesce(list_aggregate(r[node % 16 + 2 : 16], 'string_agg', ''), '') AS b
    FROM (SELECT i.*, nodes[node // 16 * 16 + 1 : node // 16 * 16 + 16] AS r FROM above i JOIN top USING (level) WHERE len(nodes) > 1) f)
)
SELECT doc_id, leaf, subroot, nodes[1] AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = nodes[1] AS verified, source, position
FROM above JOIN top USING (level) WHERE len(nodes) = 1
"""
