"""How well findings meet what is known: confusion, accuracy by rule, calibration, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(predicted: DataFrame, observed: DataFrame) -> DataFrame:
    """(case, category) sets to counts, precision, recall and F1 for each category."""
    p = predicted.select("case", "category").distinct().withColumn("_p", F.lit(1))
    o = observed.select("case", "category").distinct().withColumn("_o", F.lit(1))
    n = p.join(o, ["case", "category"], "full").groupBy("category").agg(
        F.count(F.when(F.col("_p").isNotNull() & F.col("_o").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("_o").isNull(), 1)).alias("fp"), F.count(F.when(F.col("_p").isNull(), 1)).alias("fn")
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n = n.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return n.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def normal(subject: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(subject)), r"[-_\s]+", "-")


def simple(subject: Column) -> Column:
    return F.element_at(F.split(normal(subject), r"[./]"), -1)


def subject_matches(predicted: DataFrame, attributed: DataFrame) -> DataFrame:
    """predicted and attributed: (case, category, subject). Pairs equal after normalisation, of one
    simple name, or where one name holds the other; meets are within a case and category."""
    a = predicted.withColumnsRenamed({"subject": "a"}).distinct()
    b = attributed.withColumnsRenamed({"subject": "b"}).distinct()
    met = a.join(b, ["case", "category"])
    x, y = normal(F.col("a")), normal(F.col("b"))
    return met.where((x == y) | (simple(F.col("a")) == simple(F.col("b"))) | F.contains(x, y) | F.contains(y, x)).select("case", "category", "a", "b").distinct()


def finding_rows(findings: DataFrame, attributed: DataFrame, threshold: float) -> DataFrame:
    """findings: (finding_id, case, category, subject, rule_id, confidence). Each with its outcome and the first
    subject that it matches."""
    m = subject_matches(findings.select("case", "category", "subject"), attributed).groupBy("case", "category", F.col("a").alias("subject")).agg(F.min("b").alias("matched"))
    out = findings.join(m, ["case", "category", "subject"], "left")
    outcome = F.when(F.col("confidence") < threshold, "below-threshold").when(F.col("matched").isNotNull(), "true-positive").otherwise("false-positive")
    return out.select("finding_id", "case", "category", "rule_id", "matched", outcome.alias("outcome"))


def rule_accuracy(rows: DataFrame, attributed: DataFrame) -> DataFrame:
    """rows: finding_rows(). A rule misses what no finding of its category and case met, in every
    category it ever predicts."""
    n = rows.groupBy("rule_id").agg(F.count(F.when(F.col("outcome") == "true-positive", 1)).alias("tp"), F.count(F.when(F.col("outcome") == "false-positive", 1)).alias("fp"))
    predicts = rows.select("rule_id", "category").distinct()
    hit = rows.where("outcome = 'true-positive'").select("rule_id", "case", "category").distinct()
    fn = attributed.select("case", "category").distinct().join(predicts, "category").join(hit, ["rule_id", "case", "category"], "left_anti").groupBy("rule_id").agg(F.count(F.lit(1)).alias("fn"))
    return n.join(fn, "rule_id", "left").withColumn("fn", F.coalesce("fn", F.lit(0)))


def blame_precision(blamed: DataFrame, attributed: DataFrame) -> DataFrame:
    hit = attributed.select("case", "class").distinct().withColumn("_h", F.lit(1))
    n = blamed.join(hit, ["case", "class"], "left").agg(F.count(F.lit(1)).alias("blamed"), F.count("_h").alias("right"))
    return n.withColumn("precision", F.when(F.col("blamed") > 0, F.col("right") / F.col("blamed")).otherwise(0.0))


def calibrated(precision: Column, support: Column) -> Column:
    return F.when(support < 10, "note").when(precision >= 0.40, "error").when(precision >= 0.10, "warn").otherwise("note")


def macro(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.avg("precision"), F.lit(0.0)).alias("precision"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"))


def matrix(runs: DataFrame) -> DataFrame:
    """runs: (family, status)."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    g = runs.groupBy("family").agg(F.count(F.lit(1)).alias("n"), n("pass").alias("passed"), n("fail").alias("failed"))
    return g.withColumn("pass_rate", F.col("passed") / F.col("n"))
