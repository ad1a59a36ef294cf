"""Run history: a day of events is a run, an event's type a rule, its user's bucket a finding."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.model import view
from factloom.operators import history as h
from factloom.plans.base import Plans
from factloom.plans.rules import FACTS

plan = Plans()

FINDINGS = """SELECT run_id, finding_id, rule_id, category, CASE w WHEN 4 THEN 'fatal' WHEN 3 THEN 'error' WHEN 2 THEN 'warn' WHEN 1 THEN 'note' ELSE 'info' END AS severity FROM (
  SELECT substr(CAST(ts AS STRING), 1, 10) AS run_id, event_type || ':' || CAST(user_id % 20 AS STRING) AS finding_id, event_type AS rule_id,
  CASE WHEN event_type IN ('purchase', 'click') THEN 'hot' ELSE 'cold' END AS category,
  max(CASE WHEN value > 90 THEN 4 WHEN value > 70 THEN 3 WHEN value > 50 THEN 2 WHEN value > 20 THEN 1 ELSE 0 END) AS w FROM events GROUP BY 1, 2, 3, 4) e"""
AFFECTS = "SELECT DISTINCT substr(CAST(ts AS STRING), 1, 10) AS run_id, event_type || ':' || CAST(user_id % 20 AS STRING) AS finding_id, CAST(user_id AS STRING) AS component FROM events"
RUNS = "SELECT substr(CAST(ts AS STRING), 1, 10) AS run_id, min(ts) AS generated_at FROM events GROUP BY 1"
R = "CASE severity WHEN 'fatal' THEN 4 WHEN 'error' THEN 3 WHEN 'warn' THEN 2 WHEN 'note' THEN 1 ELSE 0 END"
W = f"WITH f AS ({FINDINGS}), a AS ({AFFECTS}), r AS ({RUNS})"


def tables(spark, sf):
    return view(spark, sf, FINDINGS), view(spark, sf, AFFECTS), view(spark, sf, RUNS)


@plan(f"""{W} SELECT rule_id, count(DISTINCT f.run_id) AS runs, min(generated_at) AS first_seen, max(generated_at) AS last_seen, count(DISTINCT component) AS targets
  FROM f JOIN r ON f.run_id = r.run_id LEFT JOIN a ON f.run_id = a.run_id AND f.finding_id = a.finding_id GROUP BY rule_id HAVING count(DISTINCT f.run_id) >= 2""")
def h1_recurring(spark, sf):
    return h.recurring(*tables(spark, sf))


@plan(f"{W} SELECT rule_id, category, count(*) AS n, count(DISTINCT run_id) AS runs, CASE max({R}) WHEN 4 THEN 'fatal' WHEN 3 THEN 'error' WHEN 2 THEN 'warn' WHEN 1 THEN 'note' ELSE 'info' END AS worst FROM f GROUP BY rule_id, category")
def h2_risk_patterns(spark, sf):
    return h.risk_patterns(tables(spark, sf)[0])


@plan(f"{W} SELECT run_id, count(*) AS total, count(*) FILTER (WHERE severity IN ('error', 'fatal')) AS errors, count(*) FILTER (WHERE severity = 'warn') AS warns, count(*) FILTER (WHERE severity = 'note') AS notes FROM f GROUP BY run_id")
def h3_run_summary(spark, sf):
    return h.run_summary(tables(spark, sf)[0])


@plan(f"{W} SELECT run_id, category, severity, count(*) AS n FROM f GROUP BY 1, 2, 3")
def h4_stats(spark, sf):
    return h.stats_by(tables(spark, sf)[0], "category", "severity")


@plan(f"{W} SELECT run_id, rule_id, count(*) AS n FROM f GROUP BY 1, 2")
def h5_diff_stats(spark, sf):
    return h.stats_by(tables(spark, sf)[0], "rule_id")


@plan(f"{W} SELECT r.run_id, generated_at, count(f.run_id) AS n FROM r LEFT JOIN f ON r.run_id = f.run_id AND category = 'hot' GROUP BY 1, 2")
def h6_category_trend(spark, sf):
    f, _, r = tables(spark, sf)
    return h.category_trend(f, r, "hot")


@plan(f"{W} SELECT finding_id, count(DISTINCT component) AS n FROM a GROUP BY finding_id ORDER BY n DESC, finding_id LIMIT 10")
def h7_top_overlaps(spark, sf):
    a = tables(spark, sf)[1]
    return a.groupBy("finding_id").agg(F.countDistinct("component").alias("n")).orderBy(F.desc("n"), "finding_id").limit(10)


@plan(f"{W} SELECT run_id, generated_at FROM r ORDER BY generated_at DESC, run_id LIMIT 5")
def h8_recent_runs(spark, sf):
    return tables(spark, sf)[2].orderBy(F.desc("generated_at"), "run_id").limit(5)


PAIR = "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS run_id, CAST(o_custkey AS STRING) AS finding_id, max(o_orderpriority) AS rule_id, CASE WHEN max(o_totalprice) > 150000 THEN 'error' ELSE 'note' END AS severity FROM orders GROUP BY 1, 2"
DIFF = f"""WITH p AS ({PAIR}), b AS (SELECT coalesce(o.finding_id, n.finding_id) AS finding_id, o.severity AS os, n.severity AS ns, o.rule_id AS orr, n.rule_id AS nr
  FROM (SELECT * FROM p WHERE run_id = 'old') o FULL JOIN (SELECT * FROM p WHERE run_id = 'new') n ON o.finding_id = n.finding_id),
  c AS (SELECT finding_id, CASE WHEN orr IS NULL THEN 'added' WHEN nr IS NULL THEN 'removed' WHEN os <> ns THEN 'severity_changed' WHEN orr <> nr THEN 'rule_changed' ELSE 'unchanged' END AS change FROM b)"""


@plan(DIFF + " SELECT finding_id, change FROM c WHERE change <> 'unchanged'")
def h9_run_diff(spark, sf):
    return h.run_diff(view(spark, sf, PAIR), "old", "new").select("finding_id", "change")


@plan(DIFF + " SELECT change, count(*) AS n FROM c GROUP BY change")
def h9_diff_rollup(spark, sf):
    return h.run_diff(view(spark, sf, PAIR), "old", "new", True).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@plan("SELECT event_id AS fact_id, CAST(user_id AS STRING) AS subject, TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS capability FROM events WHERE event_type = 'view'")
def h10_capabilities(spark, sf):
    from factloom.plans.core import events_view

    return events_view(spark, sf, "view", {"k": "int"}).select("fact_id", "subject", F.col("k").alias("capability"))


@plan("SELECT event_id AS fact_id, event_type AS signal FROM events WHERE event_type IN ('click', 'view', 'error')")
def h11_signal_view(spark, sf):
    rows = view(spark, sf, "SELECT event_id AS fact_id, event_type AS signal FROM events")
    return rows.where(F.col("signal").isin("click", "view", "error"))


@plan("SELECT DISTINCT event_type AS kind FROM events")
def h12_rule_inputs(spark, sf):
    return view(spark, sf, "SELECT event_type AS kind FROM events").distinct()


@plan("""WITH e AS (SELECT o_orderdate AS run_id, min(o_orderstatus) AS status FROM orders GROUP BY 1)
  SELECT o.o_orderkey, o.o_orderstatus, e.status FROM orders o JOIN e ON o.o_orderdate = e.run_id WHERE o.o_orderstatus <> e.status""")
def h13_mismatch_per_run(spark, sf):
    o = view(spark, sf, "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders")
    e = o.groupBy("o_orderdate").agg(F.min("o_orderstatus").alias("status"))
    return o.join(e, "o_orderdate").where("o_orderstatus <> status").select("o_orderkey", "o_orderstatus", "status")


#: Facts of the rule plans' kinds, as long tables.
STORED = f"SELECT 'r' || CAST(fact_id % 3 AS STRING) AS run_id, fact_id, kind, subject, CASE WHEN fact_id % 29 = 0 THEN 'identical' ELSE class END AS class, domain, writers, status AS reason, trust_score AS line, detail AS excerpt, file AS mods, layer AS operations, CASE WHEN fact_id % 7 <> 0 THEN hot_path END AS hot_path, target FROM ({FACTS}) f"


def stored_facts(spark, sf):
    from factloom.operators.facts import project

    names = ["class", "domain", "writers", "reason", "line", "excerpt", "mods", "operations", "hot_path", "target"]
    return project(view(spark, sf, STORED), names, run_id="run_id", fact_id="fact_id", kind="kind", subject="subject", confidence="1", extractor="'orders'", source_locator="'orders'")


@plan(f"SELECT run_id, fact_id, subject AS path, class, domain, writers, reason FROM ({STORED}) s WHERE kind = 'resource_collision' AND coalesce(class, '') NOT IN ('', 'identical')")
def h14_conflict_rows(spark, sf):
    return h.conflict_rows(*stored_facts(spark, sf))


@plan(f"SELECT run_id, fact_id, subject AS signal, CAST(line AS BIGINT) AS line_no, excerpt FROM ({STORED}) s WHERE kind = 'log_signal'")
def h15_signal_rows(spark, sf):
    return h.signal_rows(*stored_facts(spark, sf))


@plan(f"SELECT run_id, fact_id, subject AS target, mods, operations, coalesce(hot_path, false) AS hot_path FROM ({STORED}) s WHERE kind = 'mixin_overlap'")
def h15_overlap_rows(spark, sf):
    return h.overlap_rows(*stored_facts(spark, sf))


@plan(f"SELECT run_id, fact_id, subject AS mod_id, target, coalesce(hot_path, false) AS hot_path FROM ({STORED}) s WHERE kind = 'high_risk_overwrite'")
def h15_overwrite_rows(spark, sf):
    return h.overwrite_rows(*stored_facts(spark, sf))


ADHOC = f"SELECT f.category, count(DISTINCT a.component) AS n FROM ({FINDINGS}) f JOIN ({AFFECTS}) a ON f.run_id = a.run_id AND f.finding_id = a.finding_id GROUP BY f.category"


@plan(ADHOC)
def h16_ad_hoc_sql(spark, sf):
    return view(spark, sf, ADHOC)


@plan(f"{W} SELECT f.run_id, f.finding_id FROM f JOIN r ON f.run_id = r.run_id WHERE generated_at >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def a13_prune(spark, sf):
    f, _, r = tables(spark, sf)
    now = view(spark, sf, "SELECT max(ts) AS m FROM events").first().m
    return h.pruned(f, h.expired_runs(r, "7d", F.lit(now).cast("timestamp_ntz"))).select("run_id", "finding_id")


@plan(f"{W} SELECT run_id, finding_id FROM f WHERE run_id <> (SELECT min(run_id) FROM f)")
def a12_clear_run(spark, sf):
    f = tables(spark, sf)[0]
    return h.pruned(f, f.agg(F.min("run_id").alias("run_id"))).select("run_id", "finding_id")
