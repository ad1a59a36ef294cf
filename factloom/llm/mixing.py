"""Mixing sources by temperature: weights are token shares raised to an exponent and normalised.

The exponent is bisected to meet a target entropy and then, if a source would repeat too often,
raised to meet the repetition limit. Weights become token budgets, and each source's budget is
filled by epochs, each a permutation of the source's blocks: whole epochs, then whole blocks of one
more, then documents of the block in which the budget ends. Blocks are documents dealt by hash, of a
bounded number of tokens, and ranked within ranges of their hash, so no window spans a source's
documents or blocks. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, stored

#: Target entropy as a share of the entropy of even weights.
ENTROPY = 0.97
#: How often a source's documents may come at most, on average.
REPEATS = 4.0
BLOCK_TOKENS = 1 << 18
#: The exponent lies in [0, 1] and is a multiple of 2 ** -STEPS.
STEPS = 24
BITS_A_PASS = 4
BROADCAST_ROWS = 5_000
#: Hexadecimal digits of a block's hash that name its range: 4,096 ranges an epoch.
RANGE_DIGITS = 3
#: What mix() adds to a document.
ADDED = ("mix_tokens", "mix_epoch", "mix_block", "mix_block_rank")


def tokens_of(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+")).cast("long")


def source_of() -> Column:
    return F.coalesce("source", F.lit(""))


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))


def exponent(shares: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget_share: float = 1.0) -> float:
    """The exponent for a stored table with column lp, the log of each source's token share. A pass
    over it probes the next BITS_A_PASS bisection steps at once; only sums come to the driver."""

    def probe(exponents: list[float]):
        cols = []
        for i, a in enumerate(exponents):
            e = F.exp(F.col("lp") * a)
            cols += [F.sum(e).alias(f"z{i}"), F.sum(e * F.col("lp")).alias(f"s{i}"), F.max(F.col("lp") * (a - 1)).alias(f"m{i}")]
        got = shares.agg(F.count(F.lit(1)).alias("n"), *cols).first()
        for i, a in enumerate(exponents):
            z, s, m = got[f"z{i}"], got[f"s{i}"], got[f"m{i}"]
            if z is None:
                yield True, True
                continue
            meets = math.log(z) - a * s / z <= entropy * math.log(got.n) + 1e-12
            yield meets, budget_share * math.exp(m) / z <= repeats * (1 + 1e-12)

    def least(which: int) -> float:
        """The smallest multiple of 2 ** -STEPS that meets a condition which holds from there on;
        1 if none below does."""
        low, width = 0.0, 1.0
        if next(probe([0.0]))[which]:
            return 0.0
        for _ in range(STEPS // BITS_A_PASS):
            n = 1 << BITS_A_PASS
            tried = [low + width * j / n for j in range(1, n)]
            first = next((j for j, ok in enumerate(probe(tried), 1) if ok[which]), n)
            low, width = low + width * (first - 1) / n, width / n
        return low + width

    return max(least(0), least(1))


def plan(rows: DataFrame, entropy=ENTROPY, repeats=REPEATS, block_tokens=BLOCK_TOKENS, budget: int | None = None) -> DataFrame:
    """What each block of each source gives to each epoch. rows: stored (doc_id, source, tokens).
    Returns (source, n_blocks, block, epoch, block_rank, room): room is the tokens of the budget
    that are left when the block begins; the block is whole if that covers it."""
    sources = rows.groupBy("source").agg(F.sum("tokens").alias("t")).where("t > 0")
    sources = stored(sources, "sources")
    total = sources.agg(F.sum("t")).first()[0] or 0
    budget = total if budget is None else budget
    shares = sources.withColumn("lp", F.log(F.col("t") / F.lit(float(max(total, 1)))))
    a = exponent(shares, entropy, repeats, budget / max(total, 1))
    z = shares.agg(F.sum(F.exp(F.col("lp") * a))).first()[0] or 1.0
    share = F.round(F.exp(F.col("lp") * a) / F.lit(z) * F.lit(float(budget))).cast("long")
    sources = shares.withColumn("budget", share).withColumn("n_blocks", n_blocks(F.col("t"), block_tokens))
    sources = small(stored(sources.select("source", "t", "budget", "n_blocks"), "budgets"), BROADCAST_ROWS)
    blocks = rows.join(sources, "source").withColumn("block", block_of(F.col("n_blocks")))
    blocks = blocks.groupBy("source", "block", "n_blocks", "t", "budget").agg(F.sum("tokens").alias("bt"))
    epochs = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("budget div t") + 1)))
    epochs = epochs.withColumn("h", _hash(F.col("source"), F.col("block"), F.col("epoch"))).withColumn("range", F.substring("h", 1, RANGE_DIGITS))
    epochs = stored(epochs, "epochs")
    # Ranges of the hash are summed first, so that no window spans the blocks of a source.
    key = ["source", "epoch", "range"]
    earlier = W.partitionBy("source", "epoch").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = epochs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("bt").alias("sum"))
    ahead = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    ranges = ranges.select(*key, ahead("n").alias("n_ahead"), ahead("sum").alias("t_ahead"))
    order = W.partitionBy(key).orderBy("h", "block")
    epochs = epochs.join(ranges, key)
    epochs = epochs.withColumn("block_rank", (F.col("n_ahead") + F.row_number().over(order)).cast("long"))
    before = F.col("t_ahead") + F.sum("bt").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("bt")
    room = F.col("budget") - F.col("t") * (F.col("epoch") - 1) - before
    epochs = epochs.withColumn("room", room).where("room > 0")
    return epochs.select("source", "n_blocks", "block", "epoch", "block_rank", "bt", "room")


def n_blocks(tokens: Column, block_tokens: int = BLOCK_TOKENS) -> Column:
    return F.greatest(F.lit(1), F.ceil(tokens / block_tokens)).cast("long")


def block_of(n: Column) -> Column:
    """A document's block, from its id alone."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), n)


def mix(docs: DataFrame, added: bool = True, **options) -> DataFrame:
    """Rows of docs as often as the budget takes them, with their columns and mix_tokens, mix_epoch,
    mix_block and mix_block_rank, which take the place of columns of these names; without added,
    with their own columns alone. A null source is the source "". Documents without tokens come
    with every epoch of their block; sources without tokens, and an empty table, give no rows.
    Documents are taken in hash order until the next would pass the budget; ties fall to the
    smaller doc_id; repeated rows are documents of their own."""
    # The document is one column throughout, so that no name of it clashes.
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), "doc_id", tokens_of().alias("mix_tokens"), source_of().alias("mix_source"))
    rows = own.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_tokens").alias("tokens"))
    rows = stored(rows, "mix-rows")
    steps = plan(rows, **options).select(
        F.col("source").alias("mix_source"), F.col("n_blocks").alias("mix_n"), F.col("block").alias("mix_block"),
        F.col("epoch").alias("mix_epoch"), F.col("block_rank").alias("mix_block_rank"),
        (F.col("room") >= F.col("bt")).alias("mix_whole"), F.col("room").alias("mix_room"),
    )
    steps = stored(steps, "mix-steps")
    sizes = small(stored(steps.select("mix_source", "mix_n").distinct(), "mix-sizes"), BROADCAST_ROWS)
    own = own.join(sizes, "mix_source").withColumn("mix_block", block_of(F.col("mix_n")))
    taken = own.join(small(steps.drop("mix_n"), BROADCAST_ROWS), ["mix_source", "mix_block"])
    order = W.partitionBy("mix_source", "mix_block", "mix_epoch").orderBy(_hash(F.col("doc_id"), F.col("mix_epoch")), "doc_id")
    part = taken.where("not mix_whole").withColumn("mix_so_far", F.sum("mix_tokens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    more = ADDED if added else ()
    out = [*(F.col("d").getField(c).alias(c) for c in docs.columns if c not in more), *more]
    return taken.where("mix_whole").select(out).unionByName(part.where("mix_so_far <= mix_room").select(out))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixture's plan without texts: (doc_id, source, tokens, epoch, block, block_rank)."""
    lean = docs.select("doc_id", "source", "text")
    return mix(lean, **options).select(
        "doc_id",
        source_of().alias("source"),
        F.col("mix_tokens").alias("tokens"),
        F.col("mix_epoch").alias("epoch"),
        F.col("mix_block").alias("block"),
        F.col("mix_block_rank").alias("block_rank"),
    )


#: The same rows in SQL, with the default parameters.
ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS tokens FROM documents
), s AS (
  SELECT source, CAST(sum(tokens) AS BIGINT) AS t FROM d GROUP BY source HAVING sum(tokens) > 0
), tot AS (SELECT CAST(sum(t) AS BIGINT) AS total, count(*) AS n FROM s),
lp AS (SELECT source, t, ln(t / CAST(total AS DOUBLE)) AS lp FROM s, tot),
bis(step, lo1, hi1, lo2, hi2) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT step + 1,
    CASE WHEN h1 THEN lo1 ELSE (lo1 + hi1) / 2 END, CASE WHEN h1 THEN (lo1 + hi1) / 2 ELSE hi1 END,
    CASE WHEN h2 THEN lo2 ELSE (lo2 + hi2) / 2 END, CASE WHEN h2 THEN (lo2 + hi2) / 2 ELSE hi2 END
  FROM (
    SELECT step, lo1, hi1, lo2, hi2,
      (SELECT ln(sum(exp((lo1 + hi1) / 2 * lp))) - (lo1 + hi1) / 2 * sum(exp((lo1 + hi1) / 2 * lp) * lp) / sum(exp((lo1 + hi1) / 2 * lp))
              <= {ENTROPY} * ln(count(*)) + 1e-12 FROM lp) AS h1,
      (SELECT exp(max(((lo2 + hi2) / 2 - 1) * lp)) / sum(exp((lo2 + hi2) / 2 * lp)) <= {REPEATS} * (1 + 1e-12) FROM lp) AS h2
    FROM bis WHERE step < {STEPS}
  )
), zero AS (
  SELECT ln(count(*)) <= {ENTROPY} * ln(count(*)) + 1e-12 AS h1, exp(max(-lp)) / count(*) <= {REPEATS} * (1 + 1e-12) AS h2 FROM lp
), al AS (
  SELECT greatest(CASE WHEN h1 THEN 0 ELSE hi1 END, CASE WHEN h2 THEN 0 ELSE hi2 END) AS a FROM bis, zero WHERE step = {STEPS}
), z AS (SELECT sum(exp(lp * a)) AS z FROM lp, al),
b AS (
  SELECT source, t, CAST(round(exp(lp * a) / z * CAST(total AS DOUBLE)) AS BIGINT) AS budget,
         greatest(1, CAST(ceil(t / CAST({BLOCK_TOKENS} AS DOUBLE)) AS BIGINT)) AS n_blocks
  FROM lp, al, z, tot
), db AS (
  SELECT d.doc_id, d.source, d.tokens, t, budget,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % n_blocks AS block
  FROM d JOIN b ON d.source = b.source
), bl AS (
  SELECT source, block, t, budget, CAST(sum(tokens) AS BIGINT) AS bt FROM db GROUP BY ALL
), be AS (
  SELECT source, block, t, budget, bt, unnest(range(1, budget // t + 2)) AS epoch FROM bl
), st AS (
  SELECT source, block, bt, epoch, row_number() OVER w AS block_rank,
         budget - t * (epoch - 1) - (sum(bt) OVER (w ROWS UNBOUNDED PRECEDING) - bt) AS room
  FROM be WINDOW w AS (PARTITION BY source, epoch ORDER BY md5(source || '|' || block || '|' || epoch), block)
), j AS (
  SELECT db.doc_id, db.source, db.tokens, st.epoch, st.block, st.block_rank, room, bt,
         sum(db.tokens) OVER (PARTITION BY st.source, st.block, st.epoch ORDER BY md5(db.doc_id || '|' || st.epoch), db.doc_id ROWS UNBOUNDED PRECEDING) AS so_far
  FROM db JOIN st ON db.source = st.source AND db.block = st.block WHERE room > 0
)
SELECT doc_id, source, tokens, epoch, block, block_rank FROM j WHERE room >= bt OR so_far <= room
"""
