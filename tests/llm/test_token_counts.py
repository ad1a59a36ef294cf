import random

import pytest

from factloom.llm import token_counts
from factloom.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


def unigram(pieces):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = [("<unk>", 0.0), *pieces] + [(f"<0x{i:02X}>", 0.0) for i in range(256)]
    low = min(s for _, s in pieces)
    # The byte pieces are out of a text's reach; their score must not be the lowest.
    vocab = [(p, s if p != "<unk>" else low) for p, s in vocab]
    tok = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
    return tok


def test_counts_match_the_unigram_tokenizer(docs):
    tok = unigram(token_counts.vocabulary(PATH))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PATH).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert got[r.doc_id] == len(tok.encode(r.text or "").ids), r.text


@pytest.mark.parametrize("ties", [False, True])
def test_words_with_ties_and_unknown_signs(ties):
    rng = random.Random(2)
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.0, "é": -2.5, "▁a": -4.0}
    for _ in range(40):
        p = "".join(rng.choices("abé", k=rng.randint(2, 4)))
        pieces[p] = -float(rng.randint(2, 5)) if ties else -rng.random() * 9
    if ties:
        pieces |= {"▁▁": -3.0, "▁▁▁": -7.0, "▁▁a": -5.0}
    counter, tok = token_counts.Counter(list(pieces.items())), unigram(list(pieces.items()))
    texts = ["", " ", "  a", "▁", "▁▁b", "a▁b", "zz", "中a中中", "a\nb", " a ", "é" * 9]
    texts += ["".join(rng.choices("abé zq", k=rng.randint(1, 30))) for _ in range(300)]
    for t in texts:
        assert counter.count(t) == len(tok.encode(t).ids), repr(t)


def test_runs_of_spaces_and_long_texts():
    pieces = token_counts.vocabulary(PATH)
    assert any(p == "▁" * 8 for p, _ in pieces)
    counter, tok = token_counts.Counter(pieces), unigram(pieces)
    assert counter.cuts and counter.count("x" + " " * 8 + "y") == 3
    texts = ["x" + " " * n + "y" + " " * (n % 5) for n in range(1, 70)] + [" " * n for n in range(40)]
    texts += ["    if x:\n        return  y\n" * 20, "a" * 5000, "ab ▁▁ c" * 300]
    for t in texts:
        assert counter.count(t) == len(tok.encode(t).ids), repr(t)


def test_lists_of_words_end_at_cuts(monkeypatch):
    counter = token_counts.Counter(token_counts.vocabulary(PATH))
    text = "  one two   three\n four     five    " * 50
    want = counter.count(text)
    monkeypatch.setattr(token_counts, "LISTED", 7)
    assert counter.count(text) == want


def test_a_piece_across_words_keeps_texts_whole():
    pieces = [("▁", -2.0), ("a", -2.0), ("b", -2.0), ("a▁b", -1.0), ("▁▁", -3.0)]
    counter, tok = token_counts.Counter(pieces), unigram(pieces)
    assert not counter.cuts
    for t in ("a b", "a  b", "aa bb a b", "b a b a "):
        assert counter.count(t) == len(tok.encode(t).ids), repr(t)


def test_empty_table(empty):
    assert token_counts.token_counts(empty, PATH).count() == 0
