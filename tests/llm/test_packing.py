import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import packing
from factloom.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def test_pieces_are_the_tokenizers_ids_packed_gapless(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    got = packing.pack(docs, PATH, group_pieces=40).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for r in docs.select("doc_id", "text").distinct().collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        times = docs.where(f"doc_id = {r.doc_id}").count()
        pieces = sorted(by_doc[r.doc_id], key=lambda p: p.start)
        assert sum(p.length for p in pieces) == times * len(ids)
        for p in pieces:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for pieces in seqs.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at <= packing.WINDOW


@pytest.mark.parametrize("text", ["", "<|endoftext|> x", "it's 0 İ ÀÉ 中", "\x1c a", "don't ﬁ 1²³ªµ á \x85 b"])
def test_words_match_the_tokenizer(text):
    words = packing._Words(PATH)
    assert words.encode(text) == np.array(words.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 500)
    seq, off = packing.best_fit(lengths, 100)
    rooms, want = [], np.zeros(500, int)
    for i in np.argsort(-lengths, kind="stable"):
        fit = [(r, s) for s, r in enumerate(rooms) if r >= lengths[i]]
        if not fit:
            rooms.append(100)
            fit = [(100, len(rooms) - 1)]
        best = min(fit)[0]
        s = [s for r, s in fit if r == best][-1]
        want[i] = rooms[s]
        rooms[s] -= lengths[i]
    assert len(set(seq.tolist())) == len(rooms)
    assert sorted(100 - off) == sorted(want)


def test_empty_table(empty):
    assert packing.pack(empty, PATH).count() == 0


def test_one_repeated_id_is_dealt_over_all_groups(spark):
    rows = spark.range(12_000).selectExpr("if(id % 3 = 0, null, 7L) as doc_id", "'a b' as text")
    out = packing.pack(rows, tokenizer_path("word_bpe_49k.json"), group_pieces=3_000)
    groups = {r.g: r.n for r in out.groupBy((F.col("sequence_id") % 4).alias("g")).agg(F.count("*").alias("n")).collect()}
    assert len(groups) == 4 and max(groups.values()) < 4_000 and sum(groups.values()) == 12_000
