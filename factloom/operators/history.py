"""Runs over time: recurring conflicts, risk patterns, trends, diffs, pruning."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.model import severity_name, severity_rank
from factloom.operators.facts import kind_view


def window_hours(text: str) -> int:
    """'30d', '24h' or '2w' in hours; zero, negative and other units are refused."""
    m = re.fullmatch(r"(\d+)([hdw])", text.strip())
    if not m or int(m[1]) <= 0:
        raise ValueError(f"not a window: {text!r}")
    return int(m[1]) * {"h": 1, "d": 24, "w": 168}[m[2]]


def recurring(findings: DataFrame, affects: DataFrame, runs: DataFrame, least: int = 2) -> DataFrame:
    """Rules seen in at least `least` runs: runs, first and last time, distinct components."""
    rows = findings.join(runs.select("run_id", "generated_at"), "run_id").join(affects, ["run_id", "finding_id"], "left")
    out = rows.groupBy("rule_id").agg(
        F.countDistinct("run_id").alias("runs"), F.min("generated_at").alias("first_seen"), F.max("generated_at").alias("last_seen"), F.countDistinct("component").alias("targets")
    )
    return out.where(F.col("runs") >= least)


def risk_patterns(findings: DataFrame) -> DataFrame:
    """Findings, runs and worst severity for each rule and category."""
    worst = severity_name(F.max(severity_rank(F.col("severity"))))
    return findings.groupBy("rule_id", "category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("run_id").alias("runs"), worst.alias("worst"))


def run_summary(findings: DataFrame) -> DataFrame:
    n = lambda *s: F.count(F.when(F.col("severity").isin(*s), 1))
    return findings.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), n("error", "fatal").alias("errors"), n("warn").alias("warns"), n("note").alias("notes"))


def stats_by(view: DataFrame, *keys: str) -> DataFrame:
    return view.groupBy("run_id", *keys).agg(F.count(F.lit(1)).alias("n"))


def category_trend(findings: DataFrame, runs: DataFrame, category: str) -> DataFrame:
    """A category's count in each run, zero included, in time order."""
    n = findings.where(F.col("category") == category).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return runs.join(n, "run_id", "left").select("run_id", "generated_at", F.coalesce("n", F.lit(0)).alias("n")).orderBy("generated_at", "run_id")


def run_diff(findings: DataFrame, old: str, new: str, with_same: bool = False) -> DataFrame:
    """added, removed, severity_changed, rule_changed; with_same: unchanged too."""
    side = lambda r, s: findings.where(F.col("run_id") == r).select("finding_id", F.col("severity").alias(f"{s}_severity"), F.col("rule_id").alias(f"{s}_rule"))
    both = side(old, "old").join(side(new, "new"), "finding_id", "full")
    change = (
        F.when(F.col("old_rule").isNull(), "added").when(F.col("new_rule").isNull(), "removed")
        .when(F.col("old_severity") != F.col("new_severity"), "severity_changed").when(F.col("old_rule") != F.col("new_rule"), "rule_changed").otherwise("unchanged")
    )
    out = both.withColumn("change", change)
    return out if with_same else out.where("change <> 'unchanged'")


def expired_runs(runs: DataFrame, window: str, now) -> DataFrame:
    return runs.where(F.col("generated_at") < now - F.expr(f"interval {window_hours(window)} hours")).select("run_id")


def pruned(table: DataFrame, expired: DataFrame) -> DataFrame:
    return table.join(expired, "run_id", "left_anti")


def save_run(tables: dict[str, DataFrame], path: str) -> None:
    """Each table's rows of the runs it holds replace those stored; the runs table comes last."""
    for name in sorted(tables, key=lambda n: n == "runs"):
        tables[name].write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")


def conflict_rows(facts: DataFrame, attrs: DataFrame) -> DataFrame:
    """(run_id, fact_id, path, class, domain, writers, reason) of collisions that have a class and
    aren't identical."""
    rows = kind_view(facts, attrs, "resource_collision", {k: "str" for k in ("class", "domain", "writers", "reason")})
    return rows.where("class <> '' and class <> 'identical'").select("run_id", "fact_id", F.col("subject").alias("path"), "class", "domain", "writers", "reason")


def signal_rows(facts: DataFrame, attrs: DataFrame) -> DataFrame:
    """(run_id, fact_id, signal, line_no, excerpt) of the signals of logs."""
    rows = kind_view(facts, attrs, "log_signal", {"line": "int", "excerpt": "str"})
    return rows.select("run_id", "fact_id", F.col("subject").alias("signal"), F.col("line").alias("line_no"), "excerpt")


def overlap_rows(facts: DataFrame, attrs: DataFrame) -> DataFrame:
    """(run_id, fact_id, target, mods, operations, hot_path) of overlaps."""
    rows = kind_view(facts, attrs, "mixin_overlap", {"mods": "str", "operations": "str", "hot_path": "bool"})
    return rows.select("run_id", "fact_id", F.col("subject").alias("target"), "mods", "operations", F.coalesce("hot_path", F.lit(False)).alias("hot_path"))


def overwrite_rows(facts: DataFrame, attrs: DataFrame) -> DataFrame:
    """(run_id, fact_id, mod_id, target, hot_path) of overwrites."""
    rows = kind_view(facts, attrs, "high_risk_overwrite", {"target": "str", "hot_path": "bool"})
    return rows.select("run_id", "fact_id", F.col("subject").alias("mod_id"), "target", F.coalesce("hot_path", F.lit(False)).alias("hot_path"))
