"""Documents to packed windows in five stages.

Each stage takes what its predecessor kept, as a stored table, and all but the last return the
columns of documents: language identification drops what fits no language, SimHash keeps the
smallest document of each group of near duplicates, suffix-array dedup cuts passages that a smaller
document has, mixing repeats and drops documents to meet the sources' weights, and packing gives
one row for each piece of a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import language, mixing, packing, simhash, suffix_dedup
from factloom.llm.common import fresh, small, stored, table
from factloom.llm.queries import tokenizer_path

#: Ids to drop are broadcast up to so many, and joined by key beyond.
BROADCAST_ROWS = 10_000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is unknown or undecided; empty texts go."""
    rejected = stored(language.documents(docs).where("not keep").select("doc_id").distinct(), "rejected")
    return docs.join(small(rejected, BROADCAST_ROWS), "doc_id", "left_anti").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each group of near duplicates, by fingerprints of five-word
    shingles, once if its row is repeated."""
    near = simhash.similar(docs)
    others = stored(near.where("doc_id <> component_id").select("doc_id").distinct(), "others")
    digest = fresh("digest", docs.columns)
    kept = docs.join(others, "doc_id", "left_anti").withColumn(digest, F.xxhash64("text"))
    return kept.dropDuplicates(["doc_id", digest]).drop(digest)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document of smaller doc_id has too; all documents stay."""
    return suffix_dedup.without_repeats(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents as often as its weight asks."""
    return mixing.mix(docs, added=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language", known_language),
    ("near duplicates", one_of_each),
    ("passages", without_passages),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: Hashes of shingles, suffix ranks and tokens are beyond SQL; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
