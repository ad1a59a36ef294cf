"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint is cut into three segments, so two fingerprints that differ in at most five bits
have a segment that differs in at most one. Equal segments meet on the segment's value; segments
that differ in one bit meet on the value with that bit struck out. Equal fingerprints are one node
throughout. A bucket's members are compared where they meet, by exclusive-or and population count,
and a bucket gives a spanning forest of its links, never all its pairs. Buckets too large for one
task are dealt as pairs of blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mixed, stored
from .components import components

SHINGLE = 4
MAX_BITS = 4
#: First bits of the three segments, and the end.
CUTS = (0, 21, 42, 64)
#: A larger bucket is dealt as pairs of blocks of about this many fingerprints.
BLOCK = 20_000
#: A task makes the signatures of at most about so many fingerprints.
SIGNED = 200_000


def _fingerprints(width: int, prints: int = 1):
    def run(batches):
        import pyarrow as pa
        import xxhash

        h = xxhash.xxh64_intdigest
        for batch in batches:
            fps = np.zeros((batch.num_rows, prints), np.uint64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = text.encode().lower().split() if text else []
                if not words:
                    continue
                buf = b" ".join(words)
                ends = np.cumsum([len(w) + 1 for w in words]) - 1
                starts = [0, *(ends[:-1] + 1).tolist()]
                ends = ends.tolist()
                if len(words) > width:
                    starts, ends = starts[: 1 - width], ends[width - 1 :]
                else:
                    starts, ends = [0], [len(buf)]
                counts, n = np.zeros((prints, 64), np.int64), len(starts)
                for a in range(0, n, 8192):
                    part = np.array([h(buf[s:e], 42) for s, e in zip(starts[a : a + 8192], ends[a : a + 8192])], "<u8")
                    for k in range(prints):
                        own = mixed(part + np.uint64(k)) if k else part
                        counts[k] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                fps[i] = np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8")[:, 0]
            cols = [pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(prints)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "fp", *(f"fp{k}" for k in range(1, prints))])

    return run


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): 64-bit SimHash of the lower-cased word shingles, as a signed long. A text of
    fewer words has one shingle, all of them; none or null: 0."""
    schema = "doc_id long, fp long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints(width), schema)


def _signatures(fps: DataFrame) -> DataFrame:
    """(fp, key): the signatures under which fp is indexed, one for each segment and one for each
    struck-out bit. The key holds the segment, the bit and the rest of the segment."""
    keys = []
    for lo, hi in zip(CUTS, CUTS[1:], strict=False):
        seg = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        tag = lambda bit: F.lit((bit + 1) << 32 | lo << 40)
        keys.append(seg.bitwiseOR(tag(-1)))
        for bit in range(hi - lo):
            keys.append(seg.bitwiseAND(F.lit(~(1 << bit) & ((1 << (hi - lo)) - 1))).bitwiseOR(tag(bit)))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _forest(fp: np.ndarray, bit_max: int) -> list[tuple[int, int]]:
    """Links that join what pairs within bit_max join, at most one fewer than there are members.
    A hub takes all members near it at once; what is left looks for its own among all."""
    n = len(fp)
    comp = np.full(n, -1)
    links: list[tuple[int, int]] = []
    for hub in range(n):
        if comp[hub] >= 0:
            continue
        front, comp[hub] = [hub], hub
        while front:
            x = front.pop()
            near = np.flatnonzero((np.bitwise_count(fp ^ fp[x]) <= bit_max) & (comp < 0))
            if len(near):
                comp[near] = hub
                links += [(x, int(y)) for y in near]
                front += near.tolist()
    return links


def _links(bit_max: int):
    """Walks rows sorted by (key, fp), with whole buckets carried over from batch to batch."""

    def bucket_links(keys: np.ndarray, fps: np.ndarray):
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[cut, len(keys)])
        a, b = [], []
        for m in np.unique(size[size > 1]).tolist():
            at = cut[size == m]
            if m <= 32:
                # A link joins two parts of its bucket, so there is one fewer than members at most.
                part = np.tile(np.arange(m), (len(at), 1))
                for i in range(m):
                    for j in range(i + 1, m):
                        x, y = fps[at + i], fps[at + j]
                        ok = np.flatnonzero((np.bitwise_count(x ^ y) <= bit_max) & (part[:, i] != part[:, j]))
                        if len(ok):
                            a.append(x[ok])
                            b.append(y[ok])
                            own = part[ok]
                            part[ok] = np.where(own == own[:, j : j + 1], own[:, i : i + 1], own)
            else:
                for s in at.tolist():
                    own = fps[s : s + m]
                    if link := _forest(own, bit_max):
                        i, j = np.array(link).T
                        a.append(own[i])
                        b.append(own[j])
        if not a:
            return np.zeros((2, 0), np.uint64)
        return np.array([np.concatenate(a), np.concatenate(b)])

    def run(batches):
        import pyarrow as pa

        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def batch_of(pair):
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in pair], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if len(keys) < 100_000:
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield batch_of(bucket_links(keys[:last], fps[:last]))
                keys, fps = keys[last:], fps[last:]
        if len(keys):
            yield batch_of(bucket_links(keys, fps))

    return run


def links(fps: DataFrame, bit_max: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs of distinct fingerprints within bit_max bits whose classes are those of all
    such pairs. fps: one row for each distinct fingerprint."""
    if bit_max > 2 * (len(CUTS) - 1) - 1:
        raise ValueError("the segments allow at most 5 differing bits")
    # A stored table of fingerprints is a few files; their signatures are many times as much.
    tasks = max(2 * fps.sparkSession.sparkContext.defaultParallelism, -(-fps.count() // SIGNED))
    sig = _signatures(fps.repartition(tasks, "fp"))
    sizes = sig.groupBy("key").count().where(F.col("count") > block)
    hot = stored(sizes, "hot-buckets")
    if not hot.isEmpty():
        # A hot bucket's members go to every pair of blocks that has their own.
        n = F.ceil(F.col("count") / block)
        own = F.pmod(F.xxhash64("fp"), n)
        other = F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        plain = sig.join(hot, "key", "left_anti")
        wide = sig.join(hot, "key").select("fp", "key", own.alias("own"), other.alias("other"))
        wide = wide.select(
            "fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key")
        )
        sig = plain.unionByName(wide)
    dealt = sig.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_links(bit_max), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, bit_max: int = MAX_BITS, width: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: (doc_id, fingerprint, component_id, n_same). Documents link
    when their fingerprints differ in at most bit_max bits; component_id is the smallest doc_id
    that can be reached. fingerprint is 16 lowercase hex digits; n_same counts rows of the same
    fingerprint. Null, empty and white-space texts have fingerprint zero and link like any other;
    repeated rows stay; an empty table gives no rows; other columns are ignored."""
    prints = stored(fingerprints(docs, width), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_same")), "nodes")
    edges = stored(links(nodes.select("fp"), bit_max), "links")
    comp = components(edges)
    named = nodes.join(comp, nodes.fp == comp.node, "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(named.select("fp", "first", "n_same", "root"), "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    full = stored(named.join(least, "root").select("fp", "n_same", "component_id"), "classes")
    return prints.join(full, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        "n_same",
    )


def similar(docs: DataFrame, width: int = 5, bit_max: int = 5, prints: int = 3) -> DataFrame:
    """One row for each row of docs: (doc_id, component_id). As near_duplicates(), by several
    fingerprints of the same shingles, made of different hashes of them: documents link if one of
    their fingerprints differs in at most bit_max bits, which finds more of the pairs whose shingles
    are not nearly all equal. Every fingerprint's value is a node, and a document ties its own."""
    schema = "doc_id long, fp long" + "".join(f", fp{k} long" for k in range(1, prints))
    own = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints(width, prints), schema), "fingerprints")
    names = ["fp", *(f"fp{k}" for k in range(1, prints))]
    node = lambda k, c: F.xxhash64(F.lit(k), F.col(c))
    edges = None
    for k, name in enumerate(names):
        values = stored(own.select(F.col(name).alias("fp")).distinct(), "nodes")
        met = stored(links(values, bit_max).select(node(k, "a").alias("a"), node(k, "b").alias("b")), "links")
        discard(values)
        tied = own.select(node(0, "fp").alias("a"), node(k, name).alias("b")).distinct() if k else None
        for more in (met, tied):
            edges = more if edges is None else edges.unionByName(more) if more is not None else edges
    comp = components(edges)
    rooted = own.select("doc_id", node(0, "fp").alias("node")).join(comp, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("doc_id", "component_id")
