"""Fact-table queries over events as facts: kind is the event's type, subject its user, and the
attributes are value and the number in props."""

from __future__ import annotations

import uuid


from pyspark.sql import functions as F

from factloom.model import compared, literal, value, view
from factloom.operators import facts as op
from factloom.plans.base import Plans
from factloom.sources.storage import scratch

plan = Plans()

#: Events with typed columns; runs on both engines.
EVENTS = """SELECT event_id AS fact_id, event_type AS kind, CAST(user_id AS STRING) AS subject,
  value, TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k,
  substr(CAST(ts AS STRING), 1, 10) AS run_id, event_id % 7 > 2 AS flag FROM events"""


def fact_tables(spark, sf):
    df = view(spark, sf, EVENTS)
    return op.project(
        df, ["value", "k", "flag", "kind"], run_id="run_id", fact_id="fact_id", kind="kind", subject="subject",
        confidence="1.0", extractor="'events'", source_locator="concat('events/', kind)",
    )


def events_view(spark, sf, kind="purchase", keys=None):
    return op.kind_view(*fact_tables(spark, sf), kind, keys or {"value": "float", "k": "int"})


@plan(f"""WITH e AS ({EVENTS}) SELECT CAST(fact_id AS STRING) || ':high-value' AS finding_id, 'high-value' AS rule_id,
  'warn' AS severity, 'purchase by ' || subject || ' with k ' || CAST(k AS STRING) AS title, subject AS component, fact_id
  FROM e WHERE kind = 'purchase' AND value > 50 AND k >= 10""")
def slice_findings(spark, sf):
    df = events_view(spark, sf)
    hit = (compared(">", value(df, "value"), literal(50))) & compared(">=", value(df, "k"), literal(10))
    return df.where(hit).select(
        F.concat(F.col("fact_id").cast("string"), F.lit(":high-value")).alias("finding_id"),
        F.lit("high-value").alias("rule_id"), F.lit("warn").alias("severity"),
        F.concat(F.lit("purchase by "), "subject", F.lit(" with k "), F.col("k").cast("string")).alias("title"),
        F.col("subject").alias("component"), "fact_id",
    )


@plan(f"""WITH e AS ({EVENTS})
  SELECT run_id, fact_id, 'value' AS key, 'float' AS val_type, CAST(NULL AS STRING) AS val_str, CAST(NULL AS BIGINT) AS val_int, value AS val_float, CAST(NULL AS BOOLEAN) AS val_bool FROM e WHERE value IS NOT NULL
  UNION ALL SELECT run_id, fact_id, 'k', 'int', NULL, k, NULL, NULL FROM e WHERE k IS NOT NULL
  UNION ALL SELECT run_id, fact_id, 'flag', 'bool', NULL, NULL, NULL, flag FROM e WHERE flag IS NOT NULL""")
def a1_attributes(spark, sf):
    return fact_tables(spark, sf)[1]


@plan(f"""WITH e AS ({EVENTS}) SELECT run_id, fact_id, kind, subject, CAST(1.0 AS FLOAT) AS confidence, 'events' AS extractor, 'events/' || kind AS source_locator FROM e""")
def a1_facts(spark, sf):
    return fact_tables(spark, sf)[0].drop("source_line", "source_inner")


@plan(f"""WITH e AS ({EVENTS}) SELECT run_id, fact_id, kind, value, k, flag,
  CAST((CASE WHEN value IS NULL THEN 0 ELSE 1 END) + (CASE WHEN k IS NULL THEN 0 ELSE 1 END) + 1 AS INT) AS n FROM e""")
def a2_reassemble(spark, sf):
    df = op.reassemble(*fact_tables(spark, sf))
    a = F.col("attributes")
    return df.select(
        "run_id", "fact_id", "kind", a["value"]["val_float"].alias("value"), a["k"]["val_int"].alias("k"),
        a["flag"]["val_bool"].alias("flag"), F.size(a).alias("n"),
    )


@plan(f"WITH e AS ({EVENTS}) SELECT run_id, fact_id, subject, value, k FROM e WHERE kind = 'purchase'")
def a3_kind_view(spark, sf):
    return events_view(spark, sf).select("run_id", "fact_id", "subject", "value", "k")


@plan(f"WITH e AS ({EVENTS}) SELECT fact_id, CAST(-1 AS BIGINT) AS surplus, CAST(NULL AS DOUBLE) AS value FROM e WHERE fact_id % 50 = 3 AND value IS NOT NULL UNION ALL SELECT fact_id, 1, value FROM e WHERE fact_id % 50 = 3 AND value IS NOT NULL")
def a4_seeded_loss(spark, sf):
    """A store that loses some facts' values: each shows as a row too many and one too few."""
    before = view(spark, sf, EVENTS).select("run_id", "fact_id", "kind", "value", "k")
    facts, attrs = fact_tables(spark, sf)
    kept = attrs.where("not (fact_id % 50 = 3 and key = 'value')")
    a = F.col("attributes")
    after = op.reassemble(facts, kept).select("run_id", "fact_id", "kind", a["value"]["val_float"].alias("value"), a["k"]["val_int"].alias("k"))
    return op.round_trip_losses(before, after).select("fact_id", "surplus", "value")


@plan("SELECT CAST(NULL AS BIGINT) AS fact_id, CAST(NULL AS BIGINT) AS surplus WHERE 1 = 0")
def a4_round_trip(spark, sf):
    before = view(spark, sf, EVENTS).select("run_id", "fact_id", "kind", "value", "k")
    a = F.col("attributes")
    after = op.reassemble(*fact_tables(spark, sf)).select(
        "run_id", "fact_id", "kind", a["value"]["val_float"].alias("value"), a["k"]["val_int"].alias("k")
    )
    return op.round_trip_losses(before, after).select("fact_id", "surplus")


@plan(f"WITH e AS ({EVENTS}) SELECT run_id, fact_id, kind, 'flag' AS key, 'bool' AS val_type, 'int' AS type FROM e WHERE kind IN ('click', 'view')")
def a5_conformance(spark, sf):
    facts, attrs = fact_tables(spark, sf)
    kinds = ("click", "view")
    rules = [(k, a, t) for k in kinds for a, t in (("value", "float"), ("k", "float"), ("flag", "int"))]
    return op.conformance(attrs, facts, F.broadcast(op.contract_of(spark, rules)))


@plan(f"WITH e AS ({EVENTS}) SELECT run_id, kind, count(*) AS n FROM e GROUP BY run_id, kind")
def a6_kind_counts(spark, sf):
    return op.kind_counts(fact_tables(spark, sf)[0])


@plan(f"WITH e AS ({EVENTS}) SELECT fact_id, kind FROM e WHERE kind IN ('purchase', 'view')")
def a7_demanded_kinds(spark, sf):
    return op.demanded(fact_tables(spark, sf)[0], ["purchase", "view"]).select("fact_id", "kind")


@plan(f"WITH e AS ({EVENTS}) SELECT run_id, fact_id, subject, value, k FROM e WHERE kind = 'purchase'")
def a7_kind_layout(spark, sf):
    """The same view as a3, from tables laid out by kind."""
    tables = op.write_facts(*fact_tables(spark, sf), f"laid_out_{uuid.uuid4().hex}", 8)
    return op.kind_view(*tables, "purchase", {"value": "float", "k": "int"}).select("run_id", "fact_id", "subject", "value", "k")


@plan(f"WITH e AS ({EVENTS}) SELECT fact_id, kind, subject FROM e WHERE subject = '7' AND kind = 'click'")
def a8_lookup(spark, sf):
    return op.lookup(fact_tables(spark, sf)[0], "7", "click").select("fact_id", "kind", "subject")


@plan(f"WITH e AS ({EVENTS}) SELECT fact_id, kind FROM e WHERE kind = 'purchase' OR (value > 90 AND k > 50)")
def a9_retention(spark, sf):
    cited = view(spark, sf, EVENTS).where("value > 90 and k > 50").select("fact_id")
    return op.retain(fact_tables(spark, sf)[0], cited, ["purchase"], 100).select("fact_id", "kind")


@plan(f"WITH e AS ({EVENTS}) SELECT fact_id, CASE WHEN value / 100 > 1 THEN 1.0 WHEN value / 100 < 0 THEN 0.0 ELSE value / 100 END AS confidence FROM e WHERE value IS NOT NULL")
def a10_clamp(spark, sf):
    return view(spark, sf, EVENTS).where("value is not null").select("fact_id", op.clamp(F.col("value") / 100).alias("confidence"))


@plan(f"WITH e AS ({EVENTS}) SELECT run_id, fact_id, kind FROM e")
def a11_first_duplicate(spark, sf):
    facts = fact_tables(spark, sf)[0].withColumn("position", F.lit(0))
    twice = facts.unionByName(facts.withColumn("kind", F.lit("again")).withColumn("position", F.lit(1)))
    return op.first_facts(twice, "position").select("run_id", "fact_id", "kind")


@plan(f"WITH e AS ({EVENTS}) SELECT run_id, fact_id, kind, subject FROM e")
def a11_persisted_run(spark, sf):
    """Runs written twice, the second time with other kinds, and one run a third time, read back."""
    from factloom.operators.history import save_run

    facts, path = fact_tables(spark, sf)[0].select("run_id", "fact_id", "kind", "subject"), scratch(spark, "runs")
    runs = facts.select("run_id", F.lit(1).alias("version")).distinct()
    one = facts.agg(F.min("run_id").alias("run_id"))
    save_run({"runs": runs, "facts": facts.withColumn("kind", F.lit("first"))}, path)
    save_run({"runs": runs, "facts": facts}, path)
    save_run({"runs": runs.join(F.broadcast(one), "run_id"), "facts": facts.join(F.broadcast(one), "run_id")}, path)
    return spark.read.schema(facts.schema).parquet(f"{path}/facts").select("run_id", "fact_id", "kind", "subject")


@plan("""SELECT 'SPDXRef-Package-' || CAST(s_suppkey AS STRING) AS spdx_id, coalesce(s_name, CAST(s_suppkey AS STRING)) AS name,
  CASE WHEN s_nationkey % 3 = 0 THEN 'UNKNOWN' ELSE '1.' || CAST(s_nationkey AS STRING) END AS version,
  'pkg:loom/' || s_name || '@' || CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE '1.' || CAST(s_nationkey AS STRING) END || '?archive=' || CAST(s_suppkey AS STRING) || '.jar' AS purl FROM supplier""")
def a16_package_rows(spark, sf):
    from factloom.sources.packages import spdx_rows

    rows = view(spark, sf, "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
    rows = rows.select(
        F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"),
        F.when(F.col("s_nationkey") % 3 != 0, F.concat(F.lit("1."), F.col("s_nationkey").cast("string"))).alias("version"),
        F.lit("loom").alias("loader"), F.concat(F.col("s_suppkey").cast("string"), F.lit(".jar")).alias("archive"),
    )
    return spdx_rows(rows).select("spdx_id", "name", "version", "purl")


@plan("""SELECT CAST(o_orderkey AS STRING) || ':late' AS rule_instance, 'late-order' AS rule_id,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'error' ELSE 'warning' END AS level, CAST(2 AS INT) AS n_locations
  FROM orders WHERE o_orderstatus = 'F'""")
def a17_alert_rows(spark, sf):
    from factloom.sources.packages import alert_rows

    o = view(spark, sf, "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
    findings = o.select(
        F.concat(F.col("o_orderkey").cast("string"), F.lit(":late")).alias("finding_id"), F.lit("late-order").alias("rule_id"),
        F.when(F.col("o_orderpriority").startswith("1"), "error").otherwise("warn").alias("severity"),
        F.lit("late").alias("title"), F.array(F.col("o_custkey").cast("string")).alias("affects"), F.array().cast("array<string>").alias("tags"),
    )
    evidence = o.select(F.concat(F.col("o_orderkey").cast("string"), F.lit(":late")).alias("finding_id"), F.col("o_orderkey").alias("fact_id"))
    facts = o.select(F.col("o_orderkey").alias("fact_id"), F.lit("orders").alias("source_locator"), F.lit(None).cast("int").alias("source_line"))
    out = alert_rows(findings, evidence, facts)
    return out.select(F.col("finding_id").alias("rule_instance"), "rule_id", "level", F.size("locations").alias("n_locations"))


@plan(f"""WITH e AS ({EVENTS}) SELECT run_id, fact_id, kind, subject FROM e""")
def a15_snapshot(spark, sf):
    from factloom.sources.packages import read_snapshot, write_snapshot

    facts, path = fact_tables(spark, sf)[0], scratch(spark, "snapshot")
    write_snapshot(facts, path)
    return read_snapshot(spark, path, facts.schema).select("run_id", "fact_id", "kind", "subject")


@plan(f"""WITH e AS ({EVENTS}) SELECT run_id AS run, 'hot_method' AS kind, 'c' || subject AS subject, kind AS method, value AS number FROM e WHERE kind = 'click'
  UNION ALL SELECT run_id, 'hot_mod', subject, NULL, value FROM e WHERE kind = 'view' UNION ALL SELECT run_id, 'tick_spike', CAST(fact_id AS STRING), NULL, CAST(k AS DOUBLE) FROM e WHERE kind = 'purchase' AND k IS NOT NULL""")
def a18_profiles(spark, sf):
    """Each run's events as one profile report, and that read as facts."""
    from factloom.sources.packages import read_profiles

    c, path = F.col, scratch(spark, "profiles")
    some = lambda on, *cols: F.array_compact(F.collect_list(F.when(on, F.struct(*cols))))
    reports = view(spark, sf, EVENTS).groupBy(c("run_id").alias("run")).agg(
        some(c("kind") == "click", F.concat(F.lit("c"), "subject").alias("class"), c("kind").alias("method"), c("value").alias("percent")).alias("methods"),
        some(c("kind") == "view", c("subject").alias("id"), c("value").alias("percent")).alias("mods"),
        some((c("kind") == "purchase") & c("k").isNotNull(), c("fact_id").alias("tick"), c("k").alias("ms")).alias("spikes"),
    )
    reports.write.json(path)
    return read_profiles(spark, path)
