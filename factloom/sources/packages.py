"""Row layouts for other tools: package inventories, alerts, fact snapshots, profile reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.model import severity_rank


def _purl(loader, name, version, archive):
    return F.concat(F.lit("pkg:"), loader, F.lit("/"), name, F.lit("@"), F.coalesce(version, F.lit("")), F.lit("?archive="), archive)


def spdx_rows(packages: DataFrame) -> DataFrame:
    """packages: id, name, version, loader, archive. A missing name is the archive's, a missing
    version UNKNOWN."""
    name = F.coalesce("name", "archive")
    purl = _purl(F.col("loader"), name, F.col("version"), F.col("archive"))
    return packages.select(
        F.concat(F.lit("SPDXRef-Package-"), "id").alias("spdx_id"),
        name.alias("name"),
        F.coalesce("version", F.lit("UNKNOWN")).alias("version"),
        purl.alias("purl"),
        F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), purl.alias("referenceLocator")).alias("externalRef"),
    )


def cyclonedx_rows(packages: DataFrame) -> DataFrame:
    """As spdx_rows, in the other layout; a missing version stays null."""
    name = F.coalesce("name", "archive")
    return packages.select(
        F.lit("library").alias("type"), name.alias("name"), "version",
        _purl(F.col("loader"), name, F.col("version"), F.col("archive")).alias("purl"),
        F.array(F.struct(F.lit("archive").alias("name"), F.col("archive").alias("value"))).alias("properties"),
    )


def alert_rows(findings: DataFrame, evidence: DataFrame, facts: DataFrame, hidden=("explain-only", "verbose")) -> DataFrame:
    """findings that are shown by default, with a physical location for each evidence fact that
    has a source and a logical one for each component."""
    shown = findings.where(~F.arrays_overlap("tags", F.array(*map(F.lit, hidden))))
    place = F.struct(
        F.col("source_locator").alias("uri"), F.col("source_line").alias("line"), F.lit(None).cast("string").alias("component")
    )
    met = evidence.join(facts.where("source_locator is not null"), "fact_id").groupBy("finding_id").agg(F.collect_set(place).alias("_p"))
    logical = F.transform("affects", lambda a: F.struct(F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("line"), a.alias("component")))
    rank = severity_rank(F.col("severity"))
    level = F.when(rank >= 3, "error").when(rank == 2, "warning").otherwise("note")
    empty = F.array().cast("array<struct<uri:string,line:int,component:string>>")
    return shown.join(met, "finding_id", "left").select(
        "finding_id", "rule_id", level.alias("level"), F.col("title").alias("message"),
        F.concat(F.array_sort(F.coalesce("_p", empty)), logical).alias("locations"),
    )


def write_snapshot(facts: DataFrame, path: str) -> None:
    """Facts with their attribute maps as JSON lines."""
    facts.write.mode("overwrite").json(path)


def read_snapshot(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


PROFILE = (
    "run string, methods array<struct<class:string,method:string,percent:double>>,"
    " mods array<struct<id:string,percent:double>>, spikes array<struct<tick:long,ms:long>>, _bad string"
)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profile reports as (run, kind, subject, method, number) rows; a report that can't be read is
    a spark_import_failure row."""
    rows = spark.read.schema(PROFILE).option("columnNameOfCorruptRecord", "_bad").json(path)
    none = F.lit(None).cast("string")
    methods = rows.select("run", F.explode("methods").alias("m")).select("run", F.lit("hot_method").alias("kind"), F.col("m.class").alias("subject"), "m.method", F.col("m.percent").alias("number"))
    mods = rows.select("run", F.explode("mods").alias("m")).select("run", F.lit("hot_mod").alias("kind"), F.col("m.id").alias("subject"), none.alias("method"), F.col("m.percent").alias("number"))
    spikes = rows.select("run", F.explode("spikes").alias("m")).select("run", F.lit("tick_spike").alias("kind"), F.col("m.tick").cast("string").alias("subject"), none.alias("method"), F.col("m.ms").cast("double").alias("number"))
    bad = rows.where("_bad is not null").select("run", F.lit("spark_import_failure").alias("kind"), F.col("_bad").alias("subject"), none.alias("method"), F.lit(None).cast("double").alias("number"))
    return methods.unionByName(mods).unionByName(spikes).unionByName(bad)
