"""Queries over logs with stack traces. Each order is some lines of the log of its customer: traces in
many lines or flattened into one, with causes, suppressed throwables and module frames, and events
that recover, give up or write a crash report."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.model import view
from factloom.operators import runtime as rt
from factloom.operators.graph import checkpointed
from factloom.plans.base import Plans

plan = Plans()

_C, _K = "CAST(o_custkey % 5 AS STRING)", "CAST(o_orderkey AS STRING)"
CHUNKS = f"""SELECT 'logs\\' || CAST(o_custkey AS STRING) AS source, o_orderkey AS k, CASE o_orderkey % 17
  WHEN 0 THEN '[12:00:00] [Render thread/ERROR]: net.minecraft.ReportedException: charTyped event handler\n\tat com.mod' || {_C} || '.core.Keys.isDown(Keys.java:42)\n\t... 12 more\nCaused by: java.lang.IllegalStateException: GL error ' || {_K} || '\n\tat com.mod1.Item.hover(Item.java:77) ~[x.jar:1]\n\tat net.minecraft.World.tick(World.java:5)'
  WHEN 1 THEN '[12:00:00] [Render thread/ERROR]: net.minecraft.ReportedException: charTyped event handler at com.mod' || {_C} || '.core.Keys.isDown(Keys.java:42) Caused by: java.lang.IllegalStateException: GL error ' || {_K} || ' at com.mod1.Item.hover(Item.java:77)'
  WHEN 2 THEN '[12:00:01] [main/WARN] [Loader]: Could not contact update checker'
  WHEN 3 THEN '[12:00:02] [main/FATAL]: java.lang.RuntimeException: outer ' || {_K} || '\n\tat com.mod2.core.A.run(A.java:1)\n\tat com.mod0.B.call(B.java)\n\tSuppressed: java.io.IOException: closed\n\t\tat com.mod3.C.close(C.java:9)'
  WHEN 4 THEN '[12:00:03] [io/INFO]: Create 6.0 initializing!'
  WHEN 5 THEN '[12:00:03] [io/INFO] [mod/x]: java.lang.IllegalArgumentException: bad  ' || {_K} || '\n\tat TRANSFORMER/m2@6.0.10/org.far.Thing.go(Thing.java:3)\n\tat java.base/java.util.List.get(List.java:1)'
  WHEN 6 THEN '\nplain words ' || {_K} || ' at noon'
  WHEN 7 THEN 'java.lang.NullPointerException\n\tat java.util.List.get(List.java:1)\n\tat com.mod1.A.<init>(A.java:3)\n\nat com.lost.Frame.x(Frame.java:2)'
  WHEN 8 THEN '[12:00:04] [Server Watchdog/ERROR]: A single server tick took 60.00 seconds\njava.lang.Error: Watching Server\n\tat com.mod0.Loop.spin(Loop.java:8)\nnot a frame\n\tat com.mod0.Late.x(Late.java:1)'
  WHEN 9 THEN '[12:00:05] [main/ERROR]: Loading errors encountered\n    indented ' || {_K}
  WHEN 10 THEN CASE WHEN o_custkey % 3 = 0 THEN '[12:00:06] [main/INFO]: Done (3.2s)!' ELSE '[12:00:06] [main/DEBUG]: tick' END
  WHEN 11 THEN '\nCaused by: java.lang.OutOfMemoryError: heap'
  WHEN 12 THEN CASE WHEN o_custkey % 7 = 0 THEN '[12:00:07] [main/ERROR]: ---- Minecraft Crash Report ----' ELSE '[12:00:07] [main/WARN]: ' END
  WHEN 13 THEN '[12:00:08] [main/ERROR]: failed: java.io.EOFException\nCaused by: a.b.OneException: 1\n\tat com.mod1.X.y(X.java:1)\nSuppressed: a.b.TwoError: 2\nCaused by: a.b.ThreeException: 3\n\tat com.mod4.Z.w(Native Method)'
  WHEN 14 THEN '[12:00:09] [main/ERROR]: tick failed\njava.lang.IllegalStateException: bad state ' || {_K} || '\n\tat com.mod1.core.T.t(T.java:4)\n\tat com.mod2.core.U.u(U.java:5)'
  WHEN 15 THEN '[12:00:10] [main/ERROR]: Telemetry Error'
  ELSE 'java.lang.Error: second\njava.lang.Error: third' END AS text FROM orders"""
OWNERS = "SELECT 'com.mod0' AS package, 'm0' AS owner UNION ALL SELECT 'com.mod1', 'm1' UNION ALL SELECT 'com.mod1', 'm1b' UNION ALL SELECT 'com.mod2.core', 'm2' UNION ALL SELECT 'com.mod1.core', 'm1c'"


def lines(spark, sf):
    # The backslash is one in DuckDB and an escape in Spark SQL.
    chunks = view(spark, sf, CHUNKS.replace("\\'", "\\\\'"))
    parts = chunks.select("source", "k", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return parts.select("source", (F.col("k") * 16 + F.col("i")).alias("line_no"), "text")


def events(spark, sf):
    return rt.described(rt.events(lines(spark, sf)))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _has(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(w)})" for w in words) + ")"


def _field(tag: str, value: str) -> str:
    """A tagged field, in hex."""
    value = f"coalesce(CAST({value} AS STRING), '')"
    return f"lpad(printf('%x', strlen({tag})), 8, '0') || hex({tag}) || lpad(printf('%x', strlen({value})), 16, '0') || hex({value})"


_NORM = "trim(lower(regexp_replace(regexp_replace({}, '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')))"
_LIST = ", ".join(_q(m) for m in rt.TERMINAL)

#: One relation after the other: fragments, events, classified lines, nodes and frames, fingerprints.
BASE = f"""WITH ch AS ({CHUNKS}), ln AS (
  SELECT source, k * 16 + unnest(range(len(p))) AS line_no, unnest(p) AS text FROM (SELECT source, k, string_split(text, chr(10)) AS p FROM ch)
), nm AS (SELECT source, bool_or(contains(text, 'Exception') OR contains(text, 'Error')) AS named FROM ln GROUP BY source),
ct AS (
  SELECT source, line_no, text, named, list_filter(string_split(regexp_replace(text, {_q(rt.FLATTENED)}, chr(1) || '\\1', 'g'), chr(1)), lambda x: regexp_matches(x, '\\S')) AS p FROM ln JOIN nm USING (source)
), pc AS (SELECT source, line_no, CASE WHEN named AND len(p) > 0 THEN p ELSE [text] END AS p FROM ct),
fg AS (SELECT source, line_no, fragment, regexp_replace(text, '\\s+$', '') AS text FROM (SELECT source, line_no, unnest(range(len(p))) AS fragment, unnest(p) AS text FROM pc)),
k0 AS (SELECT *, regexp_replace(text, '^\\s+', '') AS t FROM fg),
k1 AS (SELECT *, t = '' AS blank, regexp_matches(t, {_q(rt.STANDARD)}) AS hd, regexp_matches(t, {_q(rt.CONTINUES)}) OR regexp_matches(text, '^\\s') AS cont FROM k0),
k2 AS (SELECT *, coalesce(lag(blank) OVER w, true) AS ab, regexp_matches(t, {_q(rt.HEADER_ONLY)}) AND NOT hd AND NOT cont AS th FROM k1 WINDOW w AS (PARTITION BY source ORDER BY line_no, fragment)),
k3 AS (SELECT *, NOT blank AND (hd OR ab OR (NOT cont AND NOT th)) AS sure FROM k2),
k4 AS (SELECT *, last_value(CASE WHEN sure THEN CASE WHEN hd THEN regexp_extract(t, {_q(rt.STANDARD)}, 3) ELSE '' END END IGNORE NULLS) OVER (PARTITION BY source ORDER BY line_no, fragment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near FROM k3),
k5 AS (SELECT *, sum(CASE WHEN sure OR (th AND NOT coalesce(near IN ('ERROR', 'FATAL'), false)) THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY line_no, fragment ROWS UNBOUNDED PRECEDING) AS event FROM k4),
ev AS (SELECT source, CAST(event AS BIGINT) AS event, min(line_no) AS line_no, arg_min(fragment, (line_no, fragment)) AS fragment, list(trim(t) ORDER BY line_no, fragment) AS p FROM k5 WHERE NOT blank GROUP BY source, event),
e1 AS (SELECT *, regexp_matches(p[1], {_q(rt.STANDARD)}) AS hd FROM ev),
e2 AS (SELECT source, event, line_no, fragment, {", ".join(f"CASE WHEN hd THEN regexp_extract(p[1], {_q(rt.STANDARD)}, {i}) ELSE '' END AS {n}" for i, n in ((1, "timestamp"), (2, "thread"), (4, "logger")))},
  CASE WHEN hd THEN regexp_extract(p[1], {_q(rt.STANDARD)}, 3) END AS level, CASE WHEN hd THEN regexp_extract(p[1], {_q(rt.STANDARD)}, 5) ELSE p[1] END AS message, p[2:] AS cont FROM e1),
q0 AS (SELECT source, event, unnest(range(1 + len(cont))) AS j, unnest([message] || cont) AS x FROM e2),
q1 AS (SELECT *, CASE WHEN regexp_matches(x, {_q(rt.AT)}) THEN 'frame' WHEN regexp_matches(x, {_q(rt.MORE)}) THEN 'more' WHEN regexp_matches(x, {_q(rt.CAUSED)}) THEN 'cause' WHEN regexp_matches(x, {_q(rt.SUPPRESSED)}) THEN 'suppressed' ELSE 'other' END AS kind,
  regexp_matches(x, {_q(rt.CAUSED)}) AS ca, regexp_matches(x, {_q(rt.THROWN)}) AS tw FROM q0),
q2 AS (SELECT *, min(j) FILTER (WHERE ca OR tw) OVER (PARTITION BY source, event) AS f FROM q1),
q3 AS (SELECT *, min(j) FILTER (WHERE j > f AND kind = 'other') OVER (PARTITION BY source, event) AS z FROM q2),
q4 AS (SELECT *, j = f OR kind IN ('cause', 'suppressed') AS node, j > f AND kind = 'suppressed' AS sup FROM q3 WHERE j >= f AND j < coalesce(z, 1000000)),
q5 AS (SELECT *, sum(CAST(node AS INT)) OVER (PARTITION BY source, event ORDER BY j) AS g FROM q4),
n0 AS (SELECT source, event, g, sup, regexp_extract(x, p, 1) AS type, nullif(trim(regexp_extract(x, p, 2)), '') AS message, row_number() OVER (PARTITION BY source, event ORDER BY sup, j) - 1 AS i, count(*) FILTER (WHERE NOT sup) OVER (PARTITION BY source, event) AS main
  FROM (SELECT *, CASE WHEN ca THEN {_q(rt.CAUSED)} WHEN tw THEN {_q(rt.THROWN)} ELSE {_q(rt.SUPPRESSED)} END AS p FROM q5 WHERE node)),
nd AS (SELECT *, CASE WHEN i + 1 < main THEN i + 1 ELSE -1 END AS cause, i = main - 1 AS deepest FROM n0),
f0 AS (SELECT source, event, g, j, regexp_replace(trim(regexp_extract(x, {_q(rt.AT)}, 1)), '^(at )+', '') AS w FROM q5 WHERE kind = 'frame' AND NOT node),
f1 AS (SELECT *, string_split(CASE WHEN contains(w, ' ~[') THEN string_split(w, ' ~[')[1] ELSE string_split(w, ' [')[1] END, '/') AS sl FROM f0),
f2 AS (SELECT *, len(sl) > 1 AND contains(sl[-1], '(') AND contains(sl[-1], '.') AS md, string_split(sl[-2], '@')[1] AS mo FROM f1),
f3 AS (SELECT *, CASE WHEN md THEN sl[-1] ELSE array_to_string(sl, '/') END AS cl, md AND mo NOT IN ({", ".join(_q(m) for m in rt.NO_MODULE)}) AS named FROM f2),
f4 AS (SELECT source, event, g, CAST(row_number() OVER (PARTITION BY source, event, g ORDER BY j) - 1 AS INT) AS fi, CASE WHEN named THEN mo ELSE '' END AS module, regexp_matches(cl, {_q(rt.CALL)}) AS kn, cl, w FROM f3),
fr AS (SELECT source, event, g, fi, module, CASE WHEN kn THEN regexp_extract(cl, {_q(rt.CALL)}, 1) ELSE w END AS class, CASE WHEN kn THEN regexp_extract(cl, {_q(rt.CALL)}, 2) ELSE '' END AS method,
  CASE WHEN kn THEN regexp_extract(cl, {_q(rt.CALL)}, 3) ELSE '' END AS file, CASE WHEN kn THEN regexp_extract(cl, {_q(rt.CALL)}, 4) ELSE '' END AS line FROM f4),
fh AS (SELECT source, event, i, string_agg({_field("'throwable:' || i || ':frame:' || fi || ':class'", "class")} || {_field("'throwable:' || i || ':frame:' || fi || ':method'", "fr.method")} || {_field("'throwable:' || i || ':frame:' || fi || ':source'", "file")} || {_field("'throwable:' || i || ':frame:' || fi || ':line'", "line")}, '' ORDER BY fi) AS h,
  string_agg({_field("'frame:' || fi || ':class'", "class")} || {_field("'frame:' || fi || ':method'", "fr.method")}, '' ORDER BY fi) AS short FROM fr JOIN nd USING (source, event, g) GROUP BY source, event, i),
nh AS (SELECT source, event, string_agg({_field("'throwable:' || i || ':type'", "type")} || {_field("'throwable:' || i || ':message'", "message")} || {_field("'throwable:' || i || ':cause'", "CASE WHEN cause >= 0 THEN cause END")} || {_field("'throwable:' || i || ':suppressed'", "sup")} || coalesce(h, ''), '' ORDER BY i) AS h,
  max(CASE WHEN deepest THEN {_field("'exception-family'", "string_split(type, '.')[-1]")} || {_field("'normalized-message'", _NORM.format("coalesce(message, '')"))} || coalesce(short, '') END) AS short,
  max(CASE WHEN deepest THEN type END) AS root, bool_or(ends_with(type, 'OutOfMemoryError') OR ends_with(type, 'VirtualMachineError')) AS oom FROM nd LEFT JOIN fh USING (source, event, i) GROUP BY source, event),
ce AS (SELECT source, event, string_agg({_field("'continuation:' || (j - 1)", "x")}, '' ORDER BY j) AS h FROM q0 WHERE j > 0 GROUP BY source, event),
t0 AS (SELECT e2.*, nh.root, coalesce(nh.oom, false) AS oom, nh.h IS NOT NULL AS has, lower(array_to_string([message] || cont, chr(10))) AS tx,
  sha256(unhex({_field("'schema'", "'runtime-semantic-v1'")} || coalesce(nh.h, {_field("'level'", "level")} || {_field("'logger'", "logger")} || {_field("'message'", "message")} || coalesce(ce.h, '')))) AS semantic_fingerprint,
  sha256(unhex({_field("'schema'", "'runtime-fuzzy-v1'")} || coalesce(nh.short, {_field("'message'", _NORM.format("message"))}))) AS fuzzy_fingerprint
  FROM e2 LEFT JOIN nh USING (source, event) LEFT JOIN ce USING (source, event)),
t1 AS (SELECT *, {_has("tx", rt.CRASH_REPORT)} AS rp, {_has("tx", rt.RECOVERED)} AS ok FROM t0),
t2 AS (SELECT *, coalesce(bool_or(rp) OVER w, false) AS lr, coalesce(bool_or(ok) OVER w, false) AS lo FROM t1 WINDOW w AS (PARTITION BY source ORDER BY event ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
t3 AS (SELECT *, CASE WHEN NOT (has OR coalesce(level IN ('ERROR', 'FATAL'), false)) THEN 'unknown'
    WHEN (contains(tx, 'update') AND contains(tx, 'check')) OR {_has("tx", ["telemetry", "could not contact"])} THEN 'background-error'
    WHEN (contains(tx, 'watchdog') OR contains(lower(thread), 'watchdog') OR contains(lower(logger), 'watchdog')) AND ({_has("tx", ["exception", "server hang", "single server tick"])} OR has) THEN 'watchdog-termination'
    WHEN {_has("tx", rt.ABORTED)} THEN 'loader-abort' WHEN rp OR lr THEN 'crash-report-root'
    WHEN coalesce(level = 'FATAL', false) OR oom OR contains(tx, 'a fatal error has been detected by the java runtime environment') THEN 'process-fatal'
    WHEN lo THEN 'recovered' ELSE 'unknown' END AS terminality FROM t2),
t4 AS (SELECT *, 'runtime-event:' || substr(semantic_fingerprint, 1, 16) || ':' || substr(sha256(unhex({_field("'source'", "replace(source, chr(92), '/')")})), 1, 12) || ':' || line_no || ':' || (event - 1) AS occurrence_id,
  CASE WHEN has AND terminality IN ({_LIST}) THEN 'causal' WHEN has AND terminality = 'unknown' THEN 'unknown' WHEN coalesce(level IN ('ERROR', 'FATAL'), false) AND terminality NOT IN ('recovered', 'background-error') THEN 'contributing' ELSE 'background' END AS crash_relevance
  FROM t3 WHERE has OR coalesce(level IN ('WARN', 'ERROR', 'FATAL'), false)),
ow AS ({OWNERS}), om AS (SELECT class, owner, rank() OVER (PARTITION BY class ORDER BY length(package) DESC) AS r FROM (SELECT DISTINCT class FROM fr) JOIN ow ON starts_with(class || '.', package || '.')),
ol AS (SELECT class, list(DISTINCT owner ORDER BY owner) AS owners FROM om WHERE r = 1 GROUP BY class),
fo AS (SELECT fr.*, i, coalesce(owners, CASE WHEN module IN (SELECT owner FROM ow) THEN [module] END, CAST([] AS VARCHAR[])) AS owners FROM fr JOIN nd USING (source, event, g) LEFT JOIN ol USING (class))
"""
_KEYS = "occurrence_id, source, line_no, semantic_fingerprint, fuzzy_fingerprint, CAST(fragment AS INT) AS normalized_fragment"


@plan(BASE + f"""SELECT {_KEYS}, timestamp, thread, coalesce(level, 'UNKNOWN') AS level, logger, substr(message, 1, 1000) AS message, CAST(len(cont) AS INT) AS continuation_count, terminality, crash_relevance,
  CAST(CASE crash_relevance WHEN 'causal' THEN 100 WHEN 'contributing' THEN 65 WHEN 'unknown' THEN 40 ELSE 15 END AS INT) AS relevance_score FROM t4""")
def l8_runtime_events(spark, sf):
    return rt.runtime_events(events(spark, sf))


@plan(BASE + f"SELECT {_KEYS}, terminality AS anchor_type, coalesce(root, '') AS root_cause_exception FROM t4 WHERE terminality IN ({_LIST})")
def l8_crash_anchors(spark, sf):
    return rt.crash_anchors(events(spark, sf))


@plan(BASE + f"SELECT {_KEYS}, CAST(i AS INT) AS index, type, coalesce(nd.message, '') AS message, CAST(cause AS INT) AS cause, deepest, sup AS suppressed FROM t4 JOIN nd USING (source, event)")
def l8_exception_chain(spark, sf):
    return rt.throwable_nodes(events(spark, sf))


@plan(BASE + f"""SELECT {_KEYS}, CAST(i AS INT) AS throwable_index, fi AS frame_index, class, method, module, file, CASE WHEN line = '' THEN -1 ELSE CAST(line AS BIGINT) END AS source_line,
  CASE WHEN regexp_matches(class, '^(java|javax|jdk|sun)\\.') THEN 'jdk' WHEN regexp_matches(class, '^(net\\.minecraft|com\\.mojang)\\.') THEN 'minecraft' WHEN regexp_matches(class, '^(net\\.minecraftforge|net\\.neoforged|net\\.fabricmc|org\\.spongepowered)\\.') THEN 'framework' ELSE 'mod-or-library' END AS classification,
  CASE WHEN len(owners) = 1 THEN owners[1] ELSE '' END AS mod_id, array_to_string(owners, ',') AS owner_candidates, CASE len(owners) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'exclusive' ELSE 'ambiguous' END AS ownership FROM t4 JOIN fo USING (source, event)""")
def l8_stack_frames(spark, sf):
    return rt.stack_frames(events(spark, sf), spark.sql(OWNERS))


@plan(BASE + "SELECT occurrence_id, fuzzy_fingerprint AS fuzzy FROM t4 WHERE has")
def l5_fuzzy_fingerprint(spark, sf):
    return rt.interesting(events(spark, sf)).where(F.size("chain") > 0).select("occurrence_id", F.col("fuzzy_fingerprint").alias("fuzzy"))


@plan(BASE + f""", an AS (SELECT t4.*, terminality IN ({_LIST}) AS anchor, last_value(CASE WHEN terminality NOT IN ({_LIST}) THEN occurrence_id END IGNORE NULLS) OVER (PARTITION BY source ORDER BY event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb FROM t4),
  rk AS (SELECT *, row_number() OVER (PARTITION BY fuzzy_fingerprint ORDER BY source, event) AS r, count(*) OVER (PARTITION BY fuzzy_fingerprint) AS n, row_number() OVER (PARTITION BY fuzzy_fingerprint ORDER BY NOT has, source, event) AS rc FROM an WHERE anchor),
  ca AS (SELECT fuzzy_fingerprint, nd.type AS cause, nd.message AS cause_message FROM rk JOIN nd USING (source, event) WHERE rc = 1 AND deepest),
  st AS (SELECT source, event, class || '.' || fo.method AS m, row_number() OVER (PARTITION BY source, event, len(owners) ORDER BY i, fi) AS up, row_number() OVER (PARTITION BY source, event, len(owners) ORDER BY i DESC, fi DESC) AS dn, len(owners) AS n, owners,
    row_number() OVER (PARTITION BY source, event, len(owners) > 1 ORDER BY i, fi) AS sh FROM fo),
  sg AS (SELECT source, event, max(m) FILTER (WHERE n = 1 AND dn = 1 AND up > 1) AS caller, max(m) FILTER (WHERE n = 1 AND up = 1) AS callee, max(m) FILTER (WHERE n > 1 AND sh = 1) AS shared,
    max(array_to_string(owners, ',')) FILTER (WHERE n > 1 AND sh = 1) AS sharers, string_agg(DISTINCT CASE WHEN n = 1 THEN owners[1] END, ',' ORDER BY CASE WHEN n = 1 THEN owners[1] END) AS contributors FROM st GROUP BY source, event)
  SELECT fuzzy_fingerprint AS fuzzy, semantic_fingerprint AS strict, occurrence_id AS first, n AS n_occurrences, cause, cause_message, caller, coalesce(callee, shared) AS callee,
    CASE WHEN callee IS NOT NULL THEN false WHEN shared IS NOT NULL THEN true END AS ambiguous, CASE WHEN callee IS NOT NULL THEN 'ordered runtime stack ownership transition' ELSE 'runtime frame ownership is shared by ' || sharers END AS rationale,
    coalesce(contributors, '') AS contributors, bb AS background_before, (SELECT count(*) FROM an WHERE NOT anchor) AS n_background
  FROM rk LEFT JOIN ca USING (fuzzy_fingerprint) LEFT JOIN sg USING (source, event) WHERE r = 1""")
def l13_incidents(spark, sf):
    rows = checkpointed(rt.interesting(events(spark, sf)))  # read thrice
    return rt.incidents(rows, rt.stack_frames(rows, spark.sql(OWNERS)))
