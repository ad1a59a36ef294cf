"""The queries of the corpus operators: name to (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import Row

from . import chat, images, language, merkle, mixing, packing, quality, rule_ledger, simhash, suffix_dedup, token_counts, topk, vector_codes
from .common import table



def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_image_copies(spark, sf_dir):
    return images.copies(images.pictures(table(spark, sf_dir, "embeddings")))


def op2_mixing(spark, sf_dir):
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op3_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_topk(spark, sf_dir):
    rows = topk.vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.where("vec_id % 20 = 0"))


def op5_chat(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    more = [Row(conv_id=-1, turn=i, role=r, text=said) for i, r in enumerate(("user", "assistant"))]
    more = spark.createDataFrame(more, "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(more.columns).unionByName(more)
    return chat.digests(chat.conversation_records(rows)).withColumnRenamed("id", "conv_id")


def op6_language(spark, sf_dir):
    return language.documents(table(spark, sf_dir, "documents"))


def op6_language_pages(spark, sf_dir):
    return language.pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_rule_ledger(spark, sf_dir):
    entries = rule_ledger.ledger(table(spark, sf_dir, "documents"))
    return rule_ledger.judged(entries, rule_ledger.POLICIES[rule_ledger.CURRENT])


def op11_rule_ablation(spark, sf_dir):
    entries = rule_ledger.ledger(table(spark, sf_dir, "documents"))
    return rule_ledger.ablation(entries, rule_ledger.POLICIES[rule_ledger.CURRENT])


def op12_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=merkle.lower_cased())


def op13_vector_codes(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def queries():
    named = (
        op1_image_copies, op2_mixing, op3_quality, op4_topk, op5_chat, op6_language, op6_language_pages,
        op7_suffix_dedup, op8_simhash, op9_token_counts, op10_packing,
        op11_rule_ledger, op11_rule_ablation, op12_merkle_manifest, op13_vector_codes,
    )
    return {f.__name__: f for f in named}


OP4_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def oracle_sql():
    policy = rule_ledger.POLICIES[rule_ledger.CURRENT]
    own = {"op11_rule_ledger": rule_ledger.verdict_sql(policy), "op11_rule_ablation": rule_ledger.ablation_sql(policy)}
    own |= {"op12_merkle_manifest": merkle.ORACLE_SQL, "op13_vector_codes": vector_codes.ORACLE_SQL}
    return own | {"op2_mixing": mixing.ORACLE_SQL, "op4_topk": OP4_SQL, "op5_chat": chat.ORACLE_SQL}
