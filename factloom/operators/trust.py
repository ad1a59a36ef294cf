"""Security signals and provenance: rollups, thresholds, confidence, trust scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signals that are high-risk alone, and evidence strengths from weak to strong.
HIGH_RISK = ("process_spawn", "unsafe", "dynamic_class", "script_engine")
STRENGTHS = ("reference", "call", "reachable")


def strength_rank(c: Column) -> Column:
    out = F.lit(0)
    for i, s in enumerate(STRENGTHS):
        out = F.when(c == s, i).otherwise(out)
    return out


def collapsed(signals: DataFrame) -> DataFrame:
    """One row for each archive and signal: structural if any detection is, the strongest evidence."""
    return signals.groupBy("archive", "signal").agg(
        F.bool_or("structural").alias("structural"), F.max(strength_rank(F.col("strength"))).alias("strength"), F.max("affected").alias("affected"), F.max("scanned").alias("scanned")
    )


def rollup(signals: DataFrame) -> DataFrame:
    """One row for each archive over its collapsed signals."""
    c = collapsed(signals)
    return c.groupBy("archive").agg(
        F.sort_array(F.collect_set("signal")).alias("signals"), F.max("strength").alias("strength"), F.max("affected").alias("affected"), F.max("scanned").alias("scanned"),
        F.count(F.when(F.col("structural"), 1)).alias("structural"), F.count(F.when(~F.col("structural"), 1)).alias("corroborated"),
    )


def emitted(rolled: DataFrame, least: int = 2) -> DataFrame:
    """Those with a high-risk signal, or with enough signals."""
    risky = F.arrays_overlap("signals", F.array(*map(F.lit, HIGH_RISK)))
    return rolled.where(risky | (F.size("signals") >= least)).withColumn("severity", F.when(risky, "warn").otherwise("note"))


def confidence() -> Column:
    """Of a rollup row."""
    n = F.col("structural") + F.col("corroborated")
    spread = F.when(F.col("scanned") > 0, F.least(F.lit(1.0), F.col("affected") / F.col("scanned"))).otherwise(0.0)
    strong = F.when(F.col("strength") == 2, 0.12).when(F.col("strength") == 1, 0.06).otherwise(0.0)
    lonely = F.when((F.col("affected") == 1) & (F.col("scanned") > 64), 0.05).otherwise(0.0)
    inferred = 0.1 * F.col("corroborated") / F.greatest(n, F.lit(1)) + F.when((F.col("structural") == 0) & (F.col("corroborated") > 0), 0.08).otherwise(0.0)
    raw = 0.55 + 0.14 * F.col("structural") / F.greatest(n, F.lit(1)) + strong + 0.12 * spread - lonely - inferred
    return F.greatest(F.lit(0.35), F.least(F.lit(0.98), raw))


#: What each known part of an identity adds.
TRUST = (("has_id", 40), ("has_version", 20), ("has_loader", 10), ("has_platform", 8), ("has_contact", 5), ("has_lock", 7), ("has_signature", 10))


def trust_score() -> Column:
    """20 and what is known, 100 at most."""
    return F.least(F.lit(100), sum((F.when(F.col(c), n).otherwise(0) for c, n in TRUST), F.lit(20)))


def bucket(score: Column) -> Column:
    s = F.coalesce(score, F.lit(0))
    return F.when(s >= 80, "high").when(s >= 50, "medium").otherwise("low")


def low_trust_capabilities(capabilities: DataFrame, trust: DataFrame, below: int = 60) -> DataFrame:
    """Archives of low trust, 0 if unknown, with a high-risk capability."""
    risky = capabilities.where(F.col("signal").isin(*HIGH_RISK)).join(trust, "archive", "left")
    score = F.coalesce("score", F.lit(0))
    return risky.where(score < below).groupBy("archive", score.alias("score")).agg(F.array_join(F.sort_array(F.collect_set("signal")), ",").alias("capabilities"))


def set_digest(rows: DataFrame, keys: list[str], line: Column) -> DataFrame:
    """(keys, digest): a Merkle digest of each group's lines, whatever their order. Equal lines are
    counted first; the lines of one of 65,536 ranges of their hashes give a digest, those of 256
    wider ranges the next, those the group's. No task holds more than a range of a group."""
    rows = rows.select(*keys, F.sha2(line, 256).alias("_h")).groupBy(*keys, "_h").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.select(*keys, F.substring("_h", 1, 4).alias("_range"), F.concat_ws(":", "_h", F.col("_n").cast("string")).alias("_d"))
    for width in (2, 0):
        rows = rows.groupBy(*keys, "_range").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_d")), ""), 256).alias("_d"))
        # The range is said with its digest, so that digests stand in the order of ranges.
        rows = rows.select(*keys, F.substring("_range", 1, width).alias("_range"), F.concat_ws("=", "_range", "_d").alias("_d"))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_d")), ""), 256).alias("digest"))


def lock_digest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One digest for each group of pinned rows, whatever their order."""
    return set_digest(rows, keys, F.concat_ws("\x1f", "id", "version", "file"))


def capability_counts(signals: DataFrame) -> DataFrame:
    """(archive, signal, n): detections of each capability."""
    return signals.groupBy("archive", "signal").agg(F.count(F.lit(1)).alias("n"))


def provenance_gaps(archives: DataFrame) -> DataFrame:
    """(archive, rule_id): archives without an id, and without a signature those that have one."""
    return archives.where("not has_id or not has_signature").select("archive", F.when(~F.col("has_id"), "unknown-source").otherwise("unsigned-jar").alias("rule_id"))
