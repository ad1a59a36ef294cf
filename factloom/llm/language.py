"""Language identification by fusing evidence.

The text gives a naive Bayes likelihood over hashed byte trigrams, tempered because neighbouring
trigrams overlap. Declared language and address suffix give likelihoods, and the host a prior; all
three come from grouped sums of what the text alone says over all rows. A host's prior is smoothed
towards its parent domain's, and that towards the overall one. One more class, "und", has even
likelihoods: what fits no language falls to it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, stored, text_chunks

BITS = 16
#: So many documents, those of the smallest hash, train the text model.
TRAIN_ROWS = 4_000
#: And at least so many of each language that has them.
LANGUAGE_ROWS = 20
#: Share of a trigram's log likelihood that counts, and the most it may add up to.
TEMPER, LIMIT = 0.2, 40.0
UNKNOWN = "und"
UNKNOWN_PRIOR = 1e-3
SMOOTH_HOST, SMOOTH_PARENT, SMOOTH_VALUE = 5.0, 20.0, 1.0
ACCEPT = 0.5
#: Evidence tables of at most so many rows are broadcast; larger ones are joined by key.
BROADCAST_ROWS = 10_000

_LOWER = np.array([b + 32 if 65 <= b <= 90 else 32 if b < 33 else b for b in range(256)], np.uint32)


def _trigrams(offsets: np.ndarray, data: np.ndarray):
    """Document index and hashed trigram of each position whose three bytes are one text's."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = _LOWER[data]
    code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    room = np.maximum(np.diff(offsets) - 2, 0)
    doc = np.repeat(np.arange(len(room)), room)
    at = np.arange(len(doc)) + np.repeat(offsets[:-1] - (np.cumsum(room) - room), room)
    return doc, (code[at] >> np.uint32(32 - BITS)).astype(np.int64)


def _counts(langs: list[str]):
    def run(batches):
        import pyarrow as pa

        total = np.zeros(len(langs) << BITS, np.int64)
        for batch in batches:
            lang = np.array([langs.index(x) for x in batch.column(1).to_pylist()], np.int64)
            for i, offsets, data in text_chunks(batch.column(0)):
                doc, tri = _trigrams(offsets, data)
                if len(doc):
                    total += np.bincount(lang[i + doc] << BITS | tri, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    return run


def train(docs: DataFrame, max_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Language names, UNKNOWN last, and log likelihoods (trigram, language). The names are all of
    the lang column; the texts those of the max_rows documents of the smallest hash, and of each
    language's own first LANGUAGE_ROWS or, if that is more, an even part of max_rows. Null languages
    are left out."""
    rank = F.xxhash64("doc_id", F.lit(11))
    known = docs.where(F.col("lang").isNotNull()).select("doc_id", "lang", rank.alias("rank"))
    seen = stored(known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.min("rank").alias("first")), "languages")
    langs = sorted(r.lang for r in seen.select("lang").collect())
    quota = max(LANGUAGE_ROWS, max_rows // max(len(langs), 1))
    # Ranks up to the bound hold about twice the quota and 100 rows, so no window has all of a language.
    share = (2 * quota + 100) / F.col("rows")
    bound = F.when(share < 1, (F.least(share, F.lit(0.999)) * 2.0**64 - 2.0**63).cast("long")).otherwise(F.lit(2**63 - 1))
    bounds = seen.select("lang", F.greatest("first", bound).alias("bound"))
    near = known.join(F.broadcast(bounds), "lang").where("rank <= bound").select("doc_id", "lang", "rank").distinct()
    place = F.row_number().over(W.partitionBy("lang").orderBy("rank", "doc_id"))
    each = near.withColumn("place", place).where(F.col("place") <= quota).select("doc_id", "lang")
    sample = known.orderBy("rank", "doc_id", "lang").limit(max_rows).select("doc_id", "lang")
    sample = stored(sample.unionByName(each).distinct(), "sample")
    table = np.full((len(langs) + 1, 1 << BITS), -BITS * np.log(2), np.float64)
    if langs:
        texts = docs.select("doc_id", "text", "lang").join(F.broadcast(sample), ["doc_id", "lang"]).select("text", "lang")
        cells = texts.mapInArrow(_counts(langs), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        cells = cells.toPandas()  # at most languages times trigrams
        n = np.zeros(len(langs) << BITS)
        n[cells["cell"]] = cells["n"]
        n = n.reshape(len(langs), -1)
        table[:-1] = np.log((n + 0.05) / (n.sum(1, keepdims=True) + 0.05 * (1 << BITS)))
    return [*langs, UNKNOWN], np.ascontiguousarray(table.T.astype(np.float32))


def _likelihoods(model: np.ndarray):
    def run(batches):
        import pyarrow as pa

        k = model.shape[1]
        by_lang = np.ascontiguousarray(model.T)
        for batch in batches:
            out = np.zeros((batch.num_rows, k))
            for i, offsets, data in text_chunks(batch.column(batch.num_columns - 1), 1 << 20):
                doc, tri = _trigrams(offsets, data)
                for j in range(k):
                    if len(doc):
                        out[i : i + len(offsets) - 1, j] = np.bincount(doc, by_lang[j][tri], len(offsets) - 1)
            out = np.maximum(TEMPER * (out - out.max(1, keepdims=True)), -LIMIT)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "ll"])

    return run


def _soft(ll: Column, k: int) -> list[Column]:
    """What the text alone says, as k columns that add up to 1."""
    total = sum((F.exp(ll[i]) for i in range(1, k)), F.exp(ll[0]))
    return [F.exp(ll[i]) / total for i in range(k)]


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1)


def parent_of(host: Column) -> Column:
    """The last two names of a host; empty where it has fewer."""
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """rows has id, text, declared and host. Returns for each of them (id, declared, host, lang,
    posterior, text_lang, keep). keep is false where the best class is UNKNOWN or below ACCEPT.
    Null, empty or white-space text: host and declaration decide alone, and keep is false. A null or empty
    declaration is no evidence; a null host has the overall prior; ties fall to the name that comes
    first; repeated rows stay; an empty table gives no rows."""
    langs, table = model
    k = len(langs)
    known = rows.select(
        F.col("id").cast("long").alias("id"),
        F.coalesce(F.lower("declared"), F.lit("")).alias("declared"),
        F.coalesce(F.lower("host"), F.lit("")).alias("host"),
        F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)).alias("has_text"),
        "text",
    )
    schema = "id long, declared string, host string, has_text boolean, ll array<double>"
    seen = stored(known.mapInArrow(_likelihoods(table), schema), "likelihoods")
    soft = seen.where("has_text").withColumns({f"p{i}": c for i, c in enumerate(_soft(F.col("ll"), k))})
    hosts = soft.groupBy("host").agg(*(F.sum(f"p{i}").alias(f"n{i}") for i in range(k)))
    hosts = stored(hosts.withColumns({"suffix": suffix_of(F.col("host")), "parent": parent_of(F.col("host"))}), "hosts")

    sums = [F.sum(f"n{i}").alias(f"n{i}") for i in range(k)]
    all_ = hosts.agg(*(F.coalesce(s, F.lit(0.0)).alias(f"n{i}") for i, s in enumerate(sums))).first()
    total = sum(all_)
    overall = [(1 - UNKNOWN_PRIOR) * (all_[i] + 1) / (total + k) for i in range(k - 1)]
    overall = [p / sum(overall) * (1 - UNKNOWN_PRIOR) for p in overall] + [UNKNOWN_PRIOR]

    def array(cols):
        return F.array(*cols).alias("v")

    def smoothed(prefix: str, prior: list[Column], m: float) -> list[Column]:
        n = sum((F.col(f"{prefix}{i}") for i in range(1, k)), F.col(f"{prefix}0"))
        return [(F.col(f"{prefix}{i}") + m * prior[i]) / (n + m) for i in range(k)]

    parents = hosts.where("parent <> ''").groupBy("parent").agg(*(F.sum(f"n{i}").alias(f"q{i}") for i in range(k)))
    flat = [F.lit(float(p)) for p in overall]
    parents = parents.select("parent", *(c.alias(f"g{i}") for i, c in enumerate(smoothed("q", flat, SMOOTH_PARENT))))
    up = hosts.join(parents, "parent", "left")
    above = [F.coalesce(f"g{i}", flat[i]) for i in range(k)]
    priors = up.select("host", F.array(*(F.log(c) for c in smoothed("n", above, SMOOTH_HOST))).alias("prior"))

    def given(values: DataFrame, name: str, out: str) -> DataFrame:
        """Log P(value | language), smoothed, from (name, n0 .. nk) sums. Nothing known is left."""
        values = values.where(F.col(name) != "")
        t = values.agg(F.count(F.lit(1)), *(F.coalesce(s, F.lit(0.0)) for s in sums)).first()
        return values.select(name, F.array(*(F.log((F.col(f"n{i}") + SMOOTH_VALUE) / (t[i + 1] + SMOOTH_VALUE * (t[0] + 1))) for i in range(k))).alias(out))

    declared = stored(soft.groupBy("declared").agg(*(F.sum(f"p{i}").alias(f"n{i}") for i in range(k))), "declared")
    suffixes = hosts.groupBy("suffix").agg(*sums)
    priors = small(stored(priors, "priors"), BROADCAST_ROWS)
    declared = small(stored(given(declared, "declared", "d"), "declared"), BROADCAST_ROWS)
    suffixes = small(stored(given(suffixes, "suffix", "s"), "suffixes"), BROADCAST_ROWS)

    fused = seen.withColumn("suffix", suffix_of(F.col("host"))).join(priors, "host", "left")
    fused = fused.join(declared, "declared", "left").join(suffixes, "suffix", "left")
    logs = [
        F.col("ll")[i] + F.coalesce(F.col("prior")[i], F.lit(float(np.log(overall[i]))))
        + F.coalesce(F.col("d")[i], F.lit(0.0)) + F.coalesce(F.col("s")[i], F.lit(0.0))
        for i in range(k)
    ]
    fused = fused.withColumn("v", F.array(*logs)).withColumn("top", F.array_max("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    names = F.array(*map(F.lit, langs))
    pick = lambda v, top: F.element_at(names, F.array_position(v, top).cast("int"))
    out = fused.select(
        "id", "declared", "host", "has_text",
        pick(F.col("v"), F.col("top")).alias("lang"),
        (1 / norm).alias("posterior"),
        F.when(F.col("has_text"), pick(F.col("ll"), F.array_max("ll"))).alias("text_lang"),
    )
    keep = F.col("has_text") & (F.col("lang") != UNKNOWN) & (F.col("posterior") >= ACCEPT)
    return out.withColumn("keep", keep).drop("has_text")


def documents(docs: DataFrame) -> DataFrame:
    """identify() over documents: the text model from their lang column, which is also what they
    declare, and their source as host."""
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    return identify(rows, train(docs)).withColumnRenamed("id", "doc_id")


def pages(pages_: DataFrame, docs: DataFrame) -> DataFrame:
    """identify() over web pages: text without markup, the language that the markup declares, and
    the address's host."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    rows = pages_.select(
        F.col("page_id").alias("id"),
        text.alias("text"),
        F.regexp_extract(html, r"""(?i)<html[^>]*\blang=["']?([a-z]+)""", 1).alias("declared"),
        F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://([^/:?#]+)", 1).alias("host"),
    )
    return identify(rows, train(docs)).withColumnRenamed("id", "page_id")
