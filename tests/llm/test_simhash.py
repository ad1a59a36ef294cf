import random
from itertools import combinations

import numpy as np
import xxhash

from factloom.llm import simhash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closed(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_matches_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    fp = {d: fingerprint(t) for d, t in rows}
    root = closed(fp, [(a, b) for a, b in combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 4])
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((d, f"{fp[d]:016x}", root[d]) for d, _ in rows)


def test_links_find_every_class_with_hot_buckets(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.int64)
    fps = set(centre.tolist())
    for c in centre.tolist():
        for _ in range(60):
            x = c
            for bit in rng.integers(0, 63, rng.integers(1, 7)).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    mask = (1 << 64) - 1
    want = closed(fps, [(a, b) for a, b in combinations(fps, 2) if ((a ^ b) & mask).bit_count() <= 4])
    for block in (simhash.BLOCK, 8):
        edges = [tuple(r) for r in simhash.links(df, block=block).collect()]
        assert all(((a ^ b) & mask).bit_count() <= 4 for a, b in edges)
        assert closed(fps, edges) == want


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    from factloom.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_similar_finds_near_copies_by_several_fingerprints(spark):
    """Documents link by any of three fingerprints; recall by the similarity of five-word shingles."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for i in range(120):
        words = [word() for _ in range(300)]
        other = list(words)
        for _ in range(1 + i % 4):
            other[rng.randrange(300)] = word()
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 240 and all(c // 2 == d // 2 for d, c in got.items())
    found = [got[2 * i + 1] == 2 * i for i in range(120)]
    assert sum(found[0::4]) >= 29 and sum(found) >= 90


def test_similar_joins_all_that_near_duplicates_joins(docs):
    one = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, 5, 5).collect()}
    more = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    assert set(more) == set(one) and all(more[d] == more[c] for d, c in one.items())


def test_a_small_bucket_gives_a_forest_of_its_links():
    """As many links as join what pairs join, in buckets of up to 32 too."""
    import pyarrow as pa

    rng = random.Random(3)
    keys, fps = [], []
    for key in range(60):
        centres = [rng.getrandbits(63) for _ in range(rng.randint(1, 3))]
        own = {rng.choice(centres) ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for _ in range(rng.randint(2, 32))}
        keys += [key] * len(own)
        fps += sorted(own)
    batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fps, pa.int64())], names=["key", "fp"])
    made = [r for out in simhash._links(4)([batch]) for r in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    groups = {k: [f for q, f in zip(keys, fps, strict=True) if q == k] for k in set(keys)}
    pairs = [(x, y) for g in groups.values() for x, y in combinations(g, 2) if (x ^ y).bit_count() <= 4]
    assert closed(fps, made) == closed(fps, pairs)
    assert len(made) < len(fps) < len(pairs)
