import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from factloom.llm import suffix_dedup


def brute(rows, k):
    first = {}
    last = (1 << 63) - (1 << 41)
    place = lambda b: (1 << 63) - 1 - int(np.uint64(xxhash.xxh64_intdigest(b, 42)).view(np.int64)) % (1 << 40)
    texts = [(t or "").encode() for _, t in rows]
    texts = [(place(b) if d is None else d, b) for (d, _), b in zip(rows, texts)]
    for d, b in texts:
        for i in range(len(b) - k + 1):
            s = b[i : i + k]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if first[b[i : i + k]] < d:
                gone[i : i + k] = b"\1" * k
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted((-1 if r[0] > last else r[0], *r[1:]) for r in out)


@pytest.mark.parametrize("threshold", [50, 16, 33])
def test_matches_brute_force(nameless, threshold):
    docs = nameless
    got = suffix_dedup.remove_repeats(docs, threshold).drop("spans").collect()
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], threshold)
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == want


def test_small_flushes_give_the_same(docs, monkeypatch):
    want = sorted(map(str, suffix_dedup.remove_repeats(docs).drop("spans").collect()))
    monkeypatch.setattr(suffix_dedup, "FLUSH", 500)
    assert sorted(map(str, suffix_dedup.remove_repeats(docs).drop("spans").collect())) == want


def test_empty_table(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert suffix_dedup.without_repeats(empty).columns == empty.columns


def test_without_repeats_keeps_rows_and_columns(docs):
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    assert out.count() == docs.count()
    docs, out = docs.where("doc_id is not null"), out.where("doc_id is not null")
    spans = {r.doc_id: r.spans for r in suffix_dedup.remove_repeats(docs).collect()}
    for r, o in zip(docs.orderBy("doc_id", "text").collect(), out.orderBy("doc_id", "text").collect()):
        if not spans[r.doc_id]:
            assert o.text == r.text
        else:
            assert o.n_chars == len(o.text) < len(r.text)


def test_equal_ranks_of_different_bytes_are_told_apart():
    """Here every rank is the same."""
    rng = np.random.default_rng(3)
    text = rng.integers(0, 3, (200, 5)).astype(np.uint8)
    doc, place, rank = rng.integers(0, 9, 200), np.arange(200), np.full(200, 7, np.uint64)
    order, d, key, kind, at = suffix_dedup._settle(rank, doc, place, lambda rows: text[rows])
    assert len(order) == 200 and (kind == suffix_dedup.OPEN).all()
    sort = np.argsort(key, kind="stable")
    low = suffix_dedup._first_of_equals(key[sort], d[sort], kind[sort], suffix_dedup._checked(text[order[sort]]))
    want = {}
    for b, x in zip(map(bytes, text), doc.tolist()):
        want[b] = min(want.get(b, 99), x)
    assert low.tolist() == [want[bytes(text[i])] for i in order[sort]]


def test_mapper_settles_equal_bytes():
    text = np.array([[1], [1], [2], [2], [1]], np.uint8)
    rank, doc = np.array([5, 5, 6, 6, 5], np.uint64), np.array([3, 1, 4, 4, 1])
    order, d, key, kind, at = suffix_dedup._settle(rank, doc, np.arange(5), lambda rows: text[rows])
    got = {(int(x), int(k)) for x, k in zip(d, kind)}
    assert got == {(3, suffix_dedup.SETTLED), (1, suffix_dedup.OPEN), (4, suffix_dedup.OPEN)}
    assert (at[kind == suffix_dedup.OPEN] & suffix_dedup.MANY).all()


def test_a_mapper_holds_little_for_each_row():
    """Every start is a row here: what is held and sorted at a time is far below the rows sent."""
    rng = np.random.default_rng(9)
    texts = ["".join(map(chr, rng.integers(97, 123, 2_000))) for _ in range(250)]
    first = suffix_dedup.lengths(50)[0]
    ranks = []
    for text in texts:
        r = suffix_dedup.Ranks(np.array([0, len(text)]), np.frombuffer(text.encode(), np.uint8), suffix_dedup._Powers(), 50)
        ranks.append(r.at(first, np.unique(r.samples())).view(np.int64))
    names = ["doc_id", "text", "ranks"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(250)), pa.array(texts), pa.array(ranks, pa.list_(pa.int64()))], names=names)
    tracemalloc.start()
    sent = [out.num_rows for out in suffix_dedup._fourth_rows(50)(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sent) == 250 * 1_951 and max(sent) < 2 * suffix_dedup.SENT
    assert peak < 150 * sum(sent)
