"""Rows without doc_id, and columns whose names helpers might have."""

from factloom.llm import language, mixing, packing, simhash, suffix_dedup, token_counts
from factloom.llm.queries import tokenizer_path


def test_every_operator_keeps_rows_without_id(nameless):
    n = nameless.count()
    for out in (
        language.documents(nameless), simhash.near_duplicates(nameless), suffix_dedup.remove_repeats(nameless),
        token_counts.token_counts(nameless, tokenizer_path("piece_bpe_32k.model")),
    ):
        assert out.count() == n and out.where("doc_id is null").count() == 3
    assert packing.pack(nameless, tokenizer_path("word_bpe_49k.json")).where("doc_id is null").count() >= 3
    assert {r.doc_id for r in mixing.mix(nameless, entropy=0.0, repeats=1.0).collect()} <= {r.doc_id for r in nameless.select("doc_id").collect()}


def test_mixing_keeps_columns_of_its_own_names(docs):
    out = mixing.mix(docs, added=False)
    assert out.columns == docs.columns
    assert {r.mix_tokens for r in out.select("mix_tokens").collect()} == {"y"}
