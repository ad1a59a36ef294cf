"""Filters, joins, aggregates, windows, sorting and graph queries over the supplied tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from factloom.model import severity_name, severity_rank, view
from factloom.operators import graph as g
from factloom.operators import query as q
from factloom.plans.base import Plans
from factloom.plans.core import EVENTS

plan = Plans()


def events(spark, sf):
    return view(spark, sf, EVENTS)


def run(spark, sf, **spec):
    """A spec over kinds, or over a table of its own name."""
    tables = {"orders": "SELECT o_orderkey AS fact_id, CAST(o_custkey AS STRING) AS subject, o_orderstatus, o_totalprice, o_orderpriority, o_custkey FROM orders",
              "customer": "SELECT c_custkey AS fact_id, CAST(c_custkey AS STRING) AS subject, c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer"}
    scan = lambda n: view(spark, sf, tables[n]) if n in tables else events(spark, sf).where(F.col("kind") == n)
    return q.QuerySpec(**spec).compile(scan)


E = f"WITH e AS ({EVENTS})"


@plan(f"{E} SELECT fact_id, value FROM e WHERE kind = 'click' AND value >= 25 AND k <> 7 AND subject > '5'")
def b1_filter(spark, sf):
    return run(spark, sf, scan="click", filters=[("value", ">=", 25), ("k", "!=", 7), ("subject", ">", "5")], project=["fact_id", "value"])


@plan(f"{E} SELECT fact_id, value, k FROM e WHERE value < k")
def b2_column_compare(spark, sf):
    df = events(spark, sf)
    return df.where(q.predicate(df, ("col", "value", "<", "k"))).select("fact_id", "value", "k")


@plan(f"{E} SELECT fact_id, k FROM e WHERE k IN (3, 5, 87)")
def b3_in_list(spark, sf):
    df = events(spark, sf)
    return df.where(q.predicate(df, ("in", "k", [3, "5", 87, None]))).select("fact_id", "k")


@plan(f"{E} SELECT fact_id, CAST(NULL AS STRING) AS missing FROM e WHERE value IS NOT NULL")
def b4_null_tests(spark, sf):
    df = events(spark, sf)
    hit = q.predicate(df, ("and", ("null", "missing"), ("not-null", "value")))
    return q.project(df.where(hit), ["fact_id", "missing"])


@plan(f"{E} SELECT fact_id FROM e WHERE (value > 80 OR k < 5) AND NOT coalesce(kind = 'view' AND k > 2, false)")
def b5_boolean(spark, sf):
    df = events(spark, sf)
    hit = ("and", ("or", ("value", ">", 80), ("k", "<", 5)), ("not", ("and", ("kind", "=", "view"), ("k", ">", 2))))
    return df.where(q.predicate(df, hit)).select("fact_id")


@plan(f"{E} SELECT fact_id, subject, CAST(NULL AS STRING) AS absent FROM e WHERE kind = 'view'")
def b6_project(spark, sf):
    return run(spark, sf, scan="view", project=["fact_id", "subject", "absent"])


@plan("""SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderstatus = 'F' GROUP BY c_mktsegment HAVING count(*) > 3""")
def b7_spec(spark, sf):
    out = run(
        spark, sf, scan="orders", join=("customer", [("o_custkey", "c_custkey")]), filters=[("o_orderstatus", "=", "F")],
        group_by=["c_mktsegment"], aggregates=[("count", None, "n"), ("sum", "o_totalprice", "total")], having=[("n", ">", 3)],
    )
    return out.withColumn("total", F.round("total", 2))


@plan(f"{E}, big AS (SELECT * FROM e WHERE kind = 'purchase' AND value > 60) SELECT subject, count(*) AS n FROM big WHERE k > 20 GROUP BY subject")
def b8_cte(spark, sf):
    big = q.QuerySpec(scan="purchase", filters=[("value", ">", 60)])
    return run(spark, sf, scan="big", with_={"big": big}, filters=[("k", ">", 20)], group_by=["subject"], aggregates=[("count", None, "n")])


@plan(f"{E} SELECT subject, count(*) AS n FROM e WHERE kind = 'click' GROUP BY subject HAVING count(*) >= 4")
def b9_having(spark, sf):
    return run(spark, sf, scan="click", group_by=["subject"], aggregates=[("count", None, "n")], having=[("n", ">=", 4)])


@plan("SELECT o_orderkey, c_custkey, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0")
def j1_inner(spark, sf):
    o, c = view(spark, sf, "SELECT * FROM orders"), view(spark, sf, "SELECT * FROM customer")
    return q.join(o, c.where("c_acctbal < 0"), [("o_custkey", "c_custkey")]).select("o_orderkey", "c_custkey", "c_acctbal")


@plan("SELECT n_name, r_name FROM nation CROSS JOIN region")
def j2_cross(spark, sf):
    return q.join(view(spark, sf, "SELECT n_name FROM nation"), view(spark, sf, "SELECT r_name FROM region"), [])


@plan(f"{E} SELECT a.fact_id AS left_id, a.subject AS left_subject, b.fact_id AS right_id, b.subject AS right_subject FROM e a JOIN e b ON a.subject = b.subject AND a.value < b.value AND b.k > 90 WHERE a.kind = 'click' AND b.kind = 'purchase'")
def j3_theta(spark, sf):
    df = events(spark, sf)
    return q.theta(df.where("kind = 'click'"), df.where("kind = 'purchase'"), "a.subject = b.subject and a.value < b.value and b.k > 90")


@plan("SELECT s_suppkey, r_name FROM supplier CROSS JOIN (SELECT r_name FROM region WHERE r_regionkey = 1) t")
def j4_tiny_side(spark, sf):
    env = view(spark, sf, "SELECT r_name FROM region WHERE r_regionkey = 1")
    return q.join(view(spark, sf, "SELECT s_suppkey FROM supplier"), env, [])


@plan("""SELECT c_custkey, o_orderkey FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON c_custkey = o_custkey""")
def j5_left(spark, sf):
    c, o = view(spark, sf, "SELECT c_custkey FROM customer"), view(spark, sf, "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P'")
    return q.join(c, o, [("c_custkey", "o_custkey")], "left").select("c_custkey", "o_orderkey")


@plan("""SELECT coalesce(a.d, b.d) AS d, a.n AS n_a, b.n AS n_b FROM (SELECT l_suppkey AS d, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a
  FULL JOIN (SELECT s_suppkey AS d, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1) b ON a.d = b.d""")
def j5_full(spark, sf):
    a = view(spark, sf, "SELECT l_suppkey AS d FROM lineitem WHERE l_returnflag = 'R'").groupBy("d").agg(F.count(F.lit(1)).alias("n_a"))
    b = view(spark, sf, "SELECT s_suppkey AS d FROM supplier WHERE s_acctbal > 0").groupBy("d").agg(F.count(F.lit(1)).alias("n_b"))
    return a.join(b, "d", "full")


@plan("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def j6_semi(spark, sf):
    rich = view(spark, sf, "SELECT o_custkey AS c_custkey FROM orders WHERE o_totalprice > 200000")
    return view(spark, sf, "SELECT c_custkey FROM customer").join(rich, "c_custkey", "left_semi")


@plan("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def j6_anti(spark, sf):
    return view(spark, sf, "SELECT c_custkey FROM customer").join(view(spark, sf, "SELECT o_custkey AS c_custkey FROM orders WHERE o_orderpriority LIKE '1%'"), "c_custkey", "left_anti")


HOSTS = "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages"
PATHS = f"SELECT page_id, regexp_replace(path, '[^a-z0-9/]', '') AS path FROM ({HOSTS}) h"
OWNERS = "SELECT 'en' AS prefix, 'english' AS owner UNION ALL SELECT 'en/1', 'low' UNION ALL SELECT 'en/2', 'low' UNION ALL SELECT 'fr', 'french' UNION ALL SELECT 'fr', 'shared' UNION ALL SELECT 'de', 'german'"


@plan(f"""WITH p AS (SELECT DISTINCT path FROM ({PATHS}) x), m AS (SELECT path, prefix, owner, rank() OVER (PARTITION BY path ORDER BY length(prefix) DESC) AS r
  FROM p JOIN ({OWNERS}) o ON starts_with(path || '/', prefix || '/'))
  SELECT path, prefix, string_agg(owner, ',' ORDER BY owner) AS owners, count(*) > 1 AS ambiguous FROM m WHERE r = 1 GROUP BY path, prefix""")
def j7_longest_prefix(spark, sf):
    items = view(spark, sf, PATHS).select("path").distinct()
    out = q.longest_prefix(items, spark.sql(OWNERS), "path", "prefix", "owner", "/")
    return out.withColumn("owners", F.array_join("owners", ","))


@plan("""WITH m AS (
  SELECT p_partkey, s_suppkey, min(tier) AS tier FROM (
    SELECT p_partkey, s_suppkey, 0 AS tier FROM part JOIN supplier ON p_size = s_nationkey AND p_partkey % 10 = s_suppkey % 10
    UNION ALL SELECT p_partkey, s_suppkey, 1 FROM part JOIN supplier ON p_size = s_nationkey) x GROUP BY 1, 2)
  SELECT p_partkey AS left_id, s_suppkey AS right_id, CASE tier WHEN 0 THEN 'exact' ELSE 'size' END AS quality FROM m""")
def j8_graded(spark, sf):
    p = view(spark, sf, "SELECT p_partkey, p_size, p_partkey % 10 AS d FROM part")
    s = view(spark, sf, "SELECT s_suppkey, s_nationkey, s_suppkey % 10 AS d FROM supplier")
    return q.graded_match(p, s, [("exact", [("p_size", "s_nationkey"), ("d", "d")]), ("size", [("p_size", "s_nationkey")])], "p_partkey", "s_suppkey")


@plan(f"""{E}, d AS (SELECT DISTINCT subject, run_id, fact_id FROM e WHERE kind = 'purchase' AND value > 95)
  SELECT a.fact_id AS id_a, b.fact_id AS id_b, a.subject FROM d a JOIN d b ON a.subject = b.subject AND a.fact_id < b.fact_id AND a.run_id <> b.run_id""")
def j11_self_pairs(spark, sf):
    d = events(spark, sf).where("kind = 'purchase' and value > 95").select("subject", "run_id", "fact_id")
    a, b = d.alias("a"), d.alias("b")
    on = (F.col("a.subject") == F.col("b.subject")) & (F.col("a.fact_id") < F.col("b.fact_id")) & (F.col("a.run_id") != F.col("b.run_id"))
    return a.join(b, on).select(F.col("a.fact_id").alias("id_a"), F.col("b.fact_id").alias("id_b"), "a.subject")


@plan("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS s, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(avg(l_discount), 6) AS a
  FROM lineitem GROUP BY 1, 2""")
def g1_aggregate(spark, sf):
    df = view(spark, sf, "SELECT l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount FROM lineitem")
    out = q.aggregate(df, ["l_returnflag", "l_linestatus"], [("count", None, "n"), ("sum", "l_quantity", "s"), ("min", "l_extendedprice", "lo"), ("max", "l_extendedprice", "hi"), ("avg", "l_discount", "a")])
    return out.withColumns({"s": F.round("s", 2), "a": F.round("a", 6)})


@plan(f"{E} SELECT count(*) AS n FROM e WHERE kind = 'no-such-kind' HAVING count(*) > 0")
def g1_global_empty(spark, sf):
    return run(spark, sf, scan="no-such-kind", aggregates=[("count", None, "n")])


@plan(f"{E} SELECT subject, count(DISTINCT kind) AS n, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS values FROM e GROUP BY subject HAVING count(DISTINCT kind) >= 3")
def g2_distinct_groups(spark, sf):
    return q.distinct_groups(events(spark, sf), "kind", 3)


@plan(f"{E} SELECT subject, max(CASE WHEN kind = 'click' THEN value END) AS click, max(CASE WHEN kind = 'purchase' THEN value END) AS purchase FROM e GROUP BY subject")
def g3_conditional_max(spark, sf):
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k)
    return events(spark, sf).groupBy("subject").agg(pick("click"), pick("purchase"))


@plan("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen FROM orders GROUP BY o_custkey")
def g4_distinct_and_times(spark, sf):
    return view(spark, sf, "SELECT * FROM orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("n"), F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"))


SEVERE = f"SELECT subject, fact_id, run_id, kind, CASE WHEN value > 90 THEN 'fatal' WHEN value > 70 THEN 'error' WHEN value > 50 THEN 'warn' WHEN value > 20 THEN 'note' ELSE 'info' END AS severity FROM ({EVENTS}) e"
RANK = "CASE severity WHEN 'fatal' THEN 4 WHEN 'error' THEN 3 WHEN 'warn' THEN 2 WHEN 'note' THEN 1 ELSE 0 END"


@plan(f"SELECT subject, CASE max({RANK}) WHEN 4 THEN 'fatal' WHEN 3 THEN 'error' WHEN 2 THEN 'warn' WHEN 1 THEN 'note' ELSE 'info' END AS worst FROM ({SEVERE}) s GROUP BY subject")
def g5_worst_severity(spark, sf):
    return view(spark, sf, SEVERE).groupBy("subject").agg(severity_name(F.max(severity_rank(F.col("severity")))).alias("worst"))


@plan(f"{E} SELECT run_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM e GROUP BY run_id")
def g6_set_union(spark, sf):
    sets = events(spark, sf).groupBy("run_id", "subject").agg(F.collect_set("kind").alias("k"))
    return sets.groupBy("run_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("k")))), ",").alias("kinds"))


@plan("""SELECT s_nationkey, CASE WHEN count(*) > 2 THEN string_agg(s_name, ', ' ORDER BY s_name) FILTER (WHERE r <= 2) || ' (+' || CAST(count(*) - 2 AS STRING) || ' more)'
  ELSE string_agg(s_name, ', ' ORDER BY s_name) END AS names FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS r FROM (SELECT DISTINCT s_nationkey, s_name FROM supplier) u) s GROUP BY s_nationkey""")
def g7_bounded_sample(spark, sf):
    return q.bounded_samples(view(spark, sf, "SELECT s_nationkey, s_name FROM supplier"), ["s_nationkey"], "s_name", 2, "names").drop("n_values")


@plan(f"{E} SELECT kind, CAST(floor(value / 10) AS BIGINT) AS bucket, count(*) AS n FROM e WHERE value IS NOT NULL GROUP BY 1, 2")
def g8_histogram(spark, sf):
    df = events(spark, sf).where("value is not null")
    return df.groupBy("kind", F.floor(F.col("value") / 10).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _ranked(fn):
    @plan(f"SELECT o_orderkey, CAST({fn}() OVER (PARTITION BY o_custkey ORDER BY o_orderdate{', o_orderkey' if fn == 'row_number' else ''}) AS INT) AS w FROM orders", f"w_{fn}")
    def query(spark, sf):
        df = view(spark, sf, "SELECT o_orderkey, o_orderkey AS fact_id, o_custkey, o_orderdate FROM orders")
        return q.window(df, fn, "w", ["o_custkey"], ["o_orderdate"]).select("o_orderkey", "w")


def _whole(fn):
    arg = "*" if fn == "count" else "o_totalprice"
    expr = f"{fn}({arg}) OVER (PARTITION BY o_custkey)"

    @plan(f"SELECT o_orderkey, {expr if fn == 'count' else f'round({expr}, 2)'} AS w FROM orders", f"w_{fn}")
    def query(spark, sf):
        df = view(spark, sf, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
        out = q.window(df, fn, "w", ["o_custkey"], column="o_totalprice")
        return out.select("o_orderkey", F.col("w") if fn == "count" else F.round("w", 2).alias("w"))


for _f in ("row_number", "rank", "dense_rank"):
    _ranked(_f)
for _f in ("count", "sum", "min", "max", "avg"):
    _whole(_f)


@plan("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def t1_top(spark, sf):
    return view(spark, sf, "SELECT p_partkey, p_retailprice FROM part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25)


@plan("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) o WHERE r = 1")
def t2_first_per_key(spark, sf):
    df = view(spark, sf, "SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
    return q.first_per(df, ["o_custkey"], F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey")


@plan("""WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS votes FROM orders GROUP BY 1, 2),
  r AS (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY votes DESC) AS r FROM n)
  SELECT o_custkey, max(o_orderpriority) AS o_orderpriority, max(votes) AS votes FROM r WHERE r = 1 GROUP BY o_custkey HAVING count(*) = 1 AND max(votes) >= 2""")
def t3_consensus(spark, sf):
    return q.consensus(view(spark, sf, "SELECT o_custkey, o_orderpriority FROM orders"), ["o_custkey"], "o_orderpriority")


@plan(f"{E} SELECT fact_id, kind FROM e WHERE kind = 'click' UNION ALL SELECT fact_id, kind FROM e WHERE kind = 'view'")
def t4_union(spark, sf):
    df = events(spark, sf).select("fact_id", "kind")
    return df.where("kind = 'click'").unionByName(df.where("kind = 'view'"))


@plan(f"SELECT kind AS rule_id, subject AS id, min(fact_id) AS fact_id FROM ({SEVERE}) s GROUP BY kind, subject")
def t5_first_finding(spark, sf):
    df = view(spark, sf, SEVERE).select(F.col("kind").alias("rule_id"), F.col("subject").alias("id"), "fact_id")
    return q.first_per(df, ["rule_id", "id"], "fact_id")


#: Each order points to the next one or two of its seven, and some last ones back to the first.
EDGES = """SELECT CAST(o_orderkey AS STRING) AS f, CAST(CASE WHEN o_orderkey % 7 < 6 THEN o_orderkey + 1 WHEN o_custkey % 3 = 0 THEN o_orderkey - 6 END AS STRING) AS t FROM orders
  UNION ALL SELECT CAST(o_orderkey AS STRING), CAST(o_orderkey + 2 AS STRING) FROM orders WHERE o_orderkey % 7 < 5 AND o_orderstatus = 'F'"""
#: Nations, their customers, those' orders and the orders' parts.
LAYERS = """SELECT 'n' || CAST(c_nationkey AS STRING) AS f, 'c' || CAST(c_custkey AS STRING) AS t FROM customer
  UNION ALL SELECT 'c' || CAST(o_custkey AS STRING), 'o' || CAST(o_orderkey AS STRING) FROM orders UNION ALL SELECT 'o' || CAST(l_orderkey AS STRING), 'p' || CAST(l_partkey AS STRING) FROM lineitem"""
PLACES = """SELECT DISTINCT 's' || CAST(s_suppkey AS STRING) AS f, 'n' || CAST(s_nationkey AS STRING) AS t FROM supplier
  UNION SELECT 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING) FROM nation"""


@plan(f"""WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({EDGES}) x WHERE t IS NOT NULL), c(f, t) AS (SELECT f, t FROM e UNION SELECT c.f, e.t FROM c JOIN e ON c.t = e.f) SELECT f, t FROM c""")
def r1_closure(spark, sf):
    return g.closure(view(spark, sf, EDGES), "f", "t")


@plan(f"""WITH RECURSIVE e AS ({PLACES}), c(f, t) AS (SELECT f, t FROM e UNION SELECT c.f, e.t FROM c JOIN e ON c.t = e.f) SELECT f, t FROM c""")
def r1_places(spark, sf):
    return g.closure(view(spark, sf, PLACES), "f", "t")


_SLICE = f"""WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({LAYERS}) x), c(node, depth) AS (SELECT 'n1', 0 UNION SELECT e.t, depth + 1 FROM c JOIN e ON c.node = e.f WHERE depth < 2),
  s AS (SELECT node, CAST(min(depth) AS INT) AS depth FROM c GROUP BY node), k AS (SELECT * FROM s ORDER BY depth, node LIMIT 4096)"""


@plan(_SLICE + " SELECT node, depth FROM k")
def r2_slice(spark, sf):
    roots = spark.createDataFrame([("n1",)], "node string")
    return g.slice_from(view(spark, sf, LAYERS), roots, 2, 4096, 8192)[0]


@plan(_SLICE + """, n AS (SELECT count(*) AS nodes FROM k), o AS (SELECT least(count(*), 8192) AS edges FROM k JOIN e ON k.node = e.f),
  d AS (SELECT count(*) > 0 AS deeper FROM s JOIN e ON s.node = e.f WHERE s.depth = 2 AND e.t NOT IN (SELECT node FROM s))
  SELECT nodes, edges, CASE WHEN deeper OR nodes >= 4096 OR edges >= 8192 THEN 'partial' ELSE 'complete' END AS coverage FROM n, o, d""")
def r2_coverage(spark, sf):
    roots = spark.createDataFrame([("n1",)], "node string")
    return g.slice_from(view(spark, sf, LAYERS), roots, 2, 4096, 8192)[1]


@plan(f"""WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({LAYERS}) x), c(node, depth, path) AS (SELECT 'n1', 0, 'n1' UNION ALL SELECT e.t, depth + 1, path || ' > ' || e.t FROM c JOIN e ON c.node = e.f)
  SELECT node, CAST(depth AS INT) AS depth, path FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, string_split(path, ' > ')) AS r FROM c) x WHERE r = 1""")
def r3_shortest_paths(spark, sf):
    return g.shortest_paths(view(spark, sf, LAYERS), "n1")


@plan(f"""WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({EDGES}) x WHERE t IS NOT NULL), c(f, t) AS (SELECT f, t FROM e UNION SELECT c.f, e.t FROM c JOIN e ON c.t = e.f)
  SELECT a.f AS node, min(b.t) AS cycle FROM c a JOIN c b ON a.f = b.f JOIN c d ON b.f = d.t AND b.t = d.f WHERE a.f = a.t GROUP BY a.f""")
def r4_cycles(spark, sf):
    return g.on_cycles(view(spark, sf, EDGES))


NEXT = "SELECT DISTINCT CAST(l_partkey AS STRING) AS f, CAST(l_suppkey AS STRING) AS t FROM lineitem"


@plan(f"WITH e AS ({NEXT}) SELECT a.f AS a, a.t AS b FROM e a JOIN e b ON a.f = b.t AND a.t = b.f WHERE a.f < a.t")
def r5_mutual(spark, sf):
    return g.mutual(view(spark, sf, NEXT))


@plan(f"WITH e AS ({NEXT}) SELECT f, t FROM e INTERSECT SELECT t, f FROM e WHERE f < t")
def r6_contradictory(spark, sf):
    e = view(spark, sf, NEXT)
    return g.contradictory(e, e.where("f < t").select(F.col("t").alias("f"), F.col("f").alias("t")))


NEEDS = "SELECT CAST(l_orderkey % 500 AS STRING) AS f, CAST(l_suppkey AS STRING) AS t, l_returnflag <> 'R' AS required, l_linestatus = 'O' AS declared FROM lineitem"


@plan(f"SELECT DISTINCT f, declared FROM ({NEEDS}) e WHERE t = '7' AND required")
def r7_dependents(spark, sf):
    return g.dependents(view(spark, sf, NEEDS), "7")


REFS = "SELECT CAST(l_suppkey AS STRING) AS node, CASE WHEN l_tax > 0.04 THEN l_returnflag END AS domain FROM lineitem"


@plan(f"""WITH d AS (SELECT t AS node, count(DISTINCT CASE WHEN declared THEN f END) AS declared, count(DISTINCT CASE WHEN NOT declared THEN f END) AS implicit FROM ({NEEDS}) e GROUP BY t),
  r AS (SELECT node, coalesce(domain, 'resource') AS domain, count(*) AS refs FROM ({REFS}) x GROUP BY 1, 2)
  SELECT r.node, domain, refs, coalesce(declared, 0) AS declared, coalesce(implicit, 0) AS implicit FROM r LEFT JOIN d ON r.node = d.node""")
def r8_blast_radius(spark, sf):
    return g.blast_radius(view(spark, sf, NEEDS), view(spark, sf, REFS))


@plan(f"{E} SELECT fact_id, value FROM e WHERE kind = 'click' AND value > 40")
def i1_incremental(spark, sf):
    """The facts arrive as two halves; what the stream has appended is the query over all."""
    from factloom.sources.storage import scratch
    from factloom.streaming.incremental import start

    at = scratch(spark, "incremental")
    facts = events(spark, sf)
    spec = q.QuerySpec(scan="click", filters=[("value", ">", 40)], project=["fact_id", "value"])
    for half in (0, 1):
        facts.where(F.col("fact_id") % 2 == half).write.mode("append").parquet(f"{at}/facts")
        start(spark, spec, f"{at}/facts", facts.schema, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema("fact_id long, value double").parquet(f"{at}/out")
