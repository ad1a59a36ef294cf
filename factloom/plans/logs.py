"""Log queries. Conversation turns are the lines of a log: their text is cut into lines, and some
are made headers, frames and exceptions by their numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.model import view
from factloom.operators import logs as lg
from factloom.operators import query as q
from factloom.plans.base import Plans

plan = Plans()

#: Line kinds by a number made of the order's keys, so that every kind of line comes in every source.
LINES = """SELECT CAST(o_custkey % 40 AS STRING) AS source, o_orderkey AS line_no, CASE o_orderkey % 31
  WHEN 0 THEN '[12:00:00] [main/ERROR]: tick failed ' || CAST(o_custkey AS STRING)
  WHEN 1 THEN 'java.lang.IllegalStateException: bad state ' || CAST(o_orderkey AS STRING)
  WHEN 2 THEN '\tat net.minecraft.World.tick(World.java:' || CAST(o_custkey AS STRING) || ')'
  WHEN 3 THEN 'Caused by: java.lang.OutOfMemoryError: heap'
  WHEN 4 THEN '\tat com.mod' || CAST(o_custkey % 5 AS STRING) || '.core.Thing.run(Thing.java:7)'
  WHEN 5 THEN '[12:00:01] [io/INFO]: ok'
  WHEN 6 THEN ''
  WHEN 7 THEN 'plain words ' || CAST(o_orderkey AS STRING)
  WHEN 8 THEN '[12:00:02] [net/FATAL]: Failed to bind to port'
  WHEN 9 THEN '... 4 more'
  WHEN 10 THEN 'Mixin apply failed for net.minecraft.World' || CAST(o_custkey % 7 AS STRING) || ': InvalidMixinException'
  WHEN 11 THEN '[12:00:03] [main/ERROR]: Mod Create' || CAST(o_custkey % 5 AS STRING) || ' requires flywheel which is missing'
  WHEN 12 THEN 'Failed to load mod extra-mod'
  WHEN 13 THEN 'java.lang.NoClassDefFoundError: foo/Bar' || CAST(o_custkey % 9 AS STRING)
  WHEN 14 THEN '	at com.mojang.Level.tick(Level.java:9)'
  WHEN 15 THEN '	at java.util.List.get(List.java:1)'
  WHEN 16 THEN '	at org.spongepowered.asm.Mixins.apply(Mixins.java:2)'
  WHEN 17 THEN 'A fatal error has been detected by the Java Runtime, StackOverflowError'
  WHEN 18 THEN 'Failed to load datapacks'
  WHEN 19 THEN 'Registry is already frozen: foo/bar_' || CAST(o_custkey % 9 AS STRING)
  WHEN 20 THEN 'Flywheel exception, Failed to create mod instance'
  WHEN 21 THEN 'Failed to load model a:b'
  WHEN 22 THEN 'GLFW error 65543'
  WHEN 23 THEN 'Sodium is required for Iris'
  WHEN 24 THEN 'removing all recipes for <item:mod:ruby_' || CAST(o_custkey % 50 AS STRING) || '>'
  WHEN 25 THEN 'Removing recipe <recipe:mod:thing_' || CAST(o_custkey % 50 AS STRING) || '>'
  WHEN 26 THEN '[groovyscript] recipe "mod:a' || CAST(o_custkey % 50 AS STRING) || '" removed'
  WHEN 27 THEN 'removed tag "#c:ores' || CAST(o_custkey % 50 AS STRING) || '"'
  WHEN 28 THEN 'clearing <tag:c:gems>, Lithium conflict'
  WHEN 29 THEN 'Running 2000ms behind, MSPT high in net.minecraft.server.Tick'
  ELSE '    indented' END AS text FROM orders"""
H, C, X = r"^\[[^\]]*\] ?\[[^\]/]*/(TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\]", r"^(\s+|\tat |at |Caused by:|Suppressed:|\.\.\. \d+ more)", r"^([A-Za-z_$][\w$]*(?:\.[\w$]+)*(?:Exception|Error|Throwable))(?::\s*(.*))?$"
EVENTS = f"""WITH l AS ({LINES}), k AS (SELECT *, regexp_matches(text, '{H}') AS h, regexp_matches(text, '{C}') AS c, regexp_matches(text, '{X}') AS x, trim(text) = '' AS b FROM l),
  a AS (SELECT *, coalesce(lag(b) OVER w, false) AS ab FROM k WINDOW w AS (PARTITION BY source ORDER BY line_no)),
  s AS (SELECT *, h OR (NOT h AND NOT c AND NOT x AND NOT b) OR (ab AND NOT b) AS sure FROM a),
  v AS (SELECT *, CASE WHEN h THEN regexp_extract(text, '{H}', 1) WHEN sure THEN '' END AS level FROM s),
  n AS (SELECT *, last_value(level IGNORE NULLS) OVER (PARTITION BY source ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near FROM v),
  t AS (SELECT *, sure OR (x AND NOT coalesce(near IN ('ERROR', 'FATAL'), false)) AS is_start FROM n),
  ev AS (SELECT source, line_no, text, level, is_start, CAST(sum(CAST(is_start AS INT)) OVER (PARTITION BY source ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event FROM t)"""


def lines(spark, sf):
    return view(spark, sf, LINES)


def whole_events(spark, sf):
    """Events with their whole text and level."""
    df = lg.assembled(lines(spark, sf))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return df.groupBy("source", "event").agg(texts.alias("text"), F.max("level").alias("level"), F.min("line_no").alias("ordinal"))


WHOLE = EVENTS + ", g AS (SELECT source, event, string_agg(text, chr(10) ORDER BY line_no) AS text, max(level) AS level, min(line_no) AS ordinal FROM ev GROUP BY source, event)"


@plan(EVENTS + " SELECT source, line_no, level, event FROM ev")
def l1_event_assembly(spark, sf):
    return lg.assembled(lines(spark, sf)).select("source", "line_no", "level", "event")


@plan(EVENTS + " SELECT source, event, count(*) AS n FROM ev GROUP BY source, event")
def w10_run_grouping(spark, sf):
    return lg.assembled(lines(spark, sf)).groupBy("source", "event").agg(F.count(F.lit(1)).alias("n"))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_NORM = "trim(lower(regexp_replace(regexp_replace({}, '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')))"


@plan(f"SELECT source, line_no, {_NORM.format('text')} AS message FROM ({LINES}) l")
def l3_normalised(spark, sf):
    return lines(spark, sf).select("source", "line_no", lg.normalised(F.col("text")).alias("message"))


_CHAIN = r"(?m)^(?:Caused by: |Suppressed: )?((?:[A-Za-z_$][\w$]*\.)+[\w$]*(?:Exception|Error))"
_SIG = "CASE " + " ".join(f"WHEN regexp_matches(text, {quoted(p)}) THEN '{n}'" for n, _, p in lg.BY_RANK) + f" WHEN regexp_matches(text, {quoted(_CHAIN)}) THEN 'RuntimeException' END"


@plan(WHOLE + f" SELECT source, event, {_SIG} AS signal FROM g WHERE {_SIG} IS NOT NULL")
def l2_signals(spark, sf):
    has = F.size(lg.chain(F.col("text"))) > 0
    return whole_events(spark, sf).select("source", "event", lg.signal(F.col("text"), has).alias("signal")).where("signal is not null")


@plan(f"SELECT line_no, sha256(CAST(length(source) AS STRING) || ':' || source || CAST(length(text) AS STRING) || ':' || text) AS strict FROM ({LINES}) l")
def l4_strict_fingerprint(spark, sf):
    return lines(spark, sf).select("line_no", lg.strict_fingerprint(F.col("source"), F.col("text")).alias("strict"))


_FRAMES = r"at ([\w$.]+)\.([\w$<>]+)\(([^)]*)\)"


@plan(WHOLE + " SELECT source, event, substr(sha256(text), 1, 12) || ':' || substr(sha256(source), 1, 12) || ':' || CAST(ordinal AS STRING) || ':' || CAST(event AS STRING) AS occurrence FROM g")
def l6_occurrence(spark, sf):
    made = lg.occurrence(F.col("text"), F.col("source"), F.col("ordinal"), F.col("event"))
    return whole_events(spark, sf).select("source", "event", made.alias("occurrence"))


_FLAGS = "level, ordinal, source, event, contains(text, 'tick') AND event % 2 = 0 AS background, false AS watchdog, false AS aborted, contains(text, 'heap') AS crash_report, contains(text, 'ok') AS recovery"


@plan(WHOLE + f""", f AS (SELECT {_FLAGS} FROM g), z AS (SELECT *, coalesce(max(CAST(crash_report AS INT)) OVER w, 0) > 0 AS lc, coalesce(max(CAST(recovery AS INT)) OVER w, 0) > 0 AS lr FROM f WINDOW w AS (PARTITION BY source ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
  SELECT source, event, CASE WHEN level IN ('ERROR', 'FATAL') THEN CASE WHEN background THEN 'background' WHEN crash_report OR lc THEN 'crash' WHEN level = 'FATAL' THEN 'fatal' WHEN lr THEN 'recovered' ELSE 'unknown' END END AS terminality FROM z""")
def l7_terminality(spark, sf):
    df = whole_events(spark, sf).selectExpr(
        "level", "ordinal", "source", "event", "contains(text, 'tick') and event % 2 = 0 as background", "false as watchdog",
        "false as aborted", "contains(text, 'heap') as crash_report", "contains(text, 'ok') as recovery",
    )
    return lg.terminality(df).select("source", "event", "terminality")


@plan(WHOLE + ", f AS (SELECT source, event, ordinal, contains(text, 'ok') AS recovery FROM g) SELECT source, event, coalesce(max(CAST(recovery AS INT)) OVER (PARTITION BY source ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) > 0 AS later FROM f")
def w9_look_ahead(spark, sf):
    rows = whole_events(spark, sf).withColumn("ok", F.contains("text", F.lit("ok")))
    return lg.with_later(rows, ["source"], "ordinal", ok="later").select("source", "event", "later")


FRAMED = WHOLE + f", fr AS (SELECT source, event, unnest(regexp_extract_all(text, '{_FRAMES}', 1)) AS cls, unnest(range(len(regexp_extract_all(text, '{_FRAMES}', 1)))) AS i FROM g)"


def framed(spark, sf):
    return whole_events(spark, sf).select("source", "event", F.posexplode(lg.frames(F.col("text"))).alias("i", "cls"))


@plan(FRAMED + " SELECT source, event, CAST(i AS INT) AS i, cls, CASE WHEN starts_with(cls, 'java.') THEN 'jdk' WHEN starts_with(cls, 'net.minecraft.') OR starts_with(cls, 'com.mojang.') THEN 'minecraft' WHEN starts_with(cls, 'org.spongepowered.') THEN 'framework' ELSE 'mod-or-library' END AS kind FROM fr")
def l9_frame_kind(spark, sf):
    return framed(spark, sf).withColumn("kind", lg.frame_kind(F.col("cls")))


OWNERS = "SELECT 'com.mod0' AS package, 'm0' AS owner UNION ALL SELECT 'com.mod1', 'm1' UNION ALL SELECT 'com.mod1', 'm1b' UNION ALL SELECT 'com.mod2.core', 'm2' UNION ALL SELECT 'com', 'any'"
OWNED = FRAMED + f""", ow AS ({OWNERS}), m AS (SELECT DISTINCT cls, package, owner, dense_rank() OVER (PARTITION BY cls ORDER BY length(package) DESC) AS r FROM fr JOIN ow ON starts_with(cls || '.', package || '.')),
  oc AS (SELECT cls, list(owner ORDER BY owner) AS owners FROM m WHERE r = 1 GROUP BY cls)"""


def owned(spark, sf):
    fr = framed(spark, sf)
    own = q.longest_prefix(fr.select("cls").distinct(), spark.sql(OWNERS), "cls", "package", "owner")
    return fr.join(own.select("cls", "owners"), "cls", "left").withColumn("owners", F.coalesce("owners", F.array().cast("array<string>")))


@plan(OWNED + " SELECT source, event, CAST(i AS INT) AS i, array_to_string(owners, ',') AS owners FROM fr JOIN oc ON fr.cls = oc.cls")
def l10_frame_owner(spark, sf):
    return owned(spark, sf).where(F.size("owners") > 0).select("source", "event", "i", F.array_join("owners", ",").alias("owners"))


@plan(OWNED + """, z AS (SELECT source || '/' || CAST(event AS STRING) AS crash, i, owners FROM fr JOIN oc ON fr.cls = oc.cls),
  b AS (SELECT crash, arg_min(owners[1], i) FILTER (WHERE len(owners) = 1) AS blamed, arg_min(array_to_string(owners, ','), i) AS f FROM z GROUP BY crash)
  SELECT crash, blamed, CASE WHEN blamed IS NULL THEN f END AS ambiguous FROM b""")
def l11_blame(spark, sf):
    return lg.blame(owned(spark, sf).select(F.concat_ws("/", "source", "event").alias("crash"), F.col("i").alias("index"), "owners"))


@plan(f"SELECT line_no, CAST(greatest(0.4, 0.92 - 0.08 * (line_no % 10)) AS DOUBLE) AS score FROM ({LINES}) l")
def l12_mention_score(spark, sf):
    return lines(spark, sf).select("line_no", lg.mention_score(F.lit(0.92), F.col("line_no") % 10).cast("double").alias("score"))


@plan(FRAMED + """, kk AS (SELECT source, event, i, cls, lag(cls) OVER (PARTITION BY source, event ORDER BY i) AS p FROM fr)
  SELECT source || '/' || CAST(event AS STRING) AS crash, string_agg(cls, ' > ' ORDER BY i) AS path FROM kk WHERE p IS NULL OR p <> cls GROUP BY 1""")
def l14_ownership_path(spark, sf):
    return lg.collapsed_path(framed(spark, sf).withColumn("crash", F.concat_ws("/", "source", "event")), "crash", "i", "cls")


@plan(WHOLE + f", c AS (SELECT source, event, regexp_extract_all(text, '{_CHAIN}', 1) AS chain FROM g) SELECT source, event, chain[1] AS outer_type, chain[len(chain)] AS root_type FROM c WHERE len(chain) > 0")
def l14_outer_and_root(spark, sf):
    df = whole_events(spark, sf).withColumn("chain", lg.chain(F.col("text"))).where(F.size("chain") > 0)
    return df.select("source", "event", F.col("chain")[0].alias("outer_type"), F.element_at("chain", -1).alias("root_type"))


@plan(FRAMED + """, kk AS (SELECT source, event, i, cls, lag(cls) OVER (PARTITION BY source, event ORDER BY i) AS p FROM fr)
  SELECT source, count(*) AS n FROM kk WHERE p IS NULL OR p <> cls GROUP BY source""")
def w11_collapse(spark, sf):
    return lg.runs(framed(spark, sf), ["source", "event"], "i", "cls").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@plan("SELECT event_id AS fact_id, value AS weight, CAST(user_id AS STRING) AS mod FROM events WHERE event_type = 'error'")
def l15_root_cause_view(spark, sf):
    from factloom.plans.core import events_view

    return events_view(spark, sf, "error", {"value": "float"}).select("fact_id", F.col("value").alias("weight"), F.col("subject").alias("mod"))


_ALL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {quoted(p)}) THEN '{n}' END" for n, p in lg.CATEGORIES) + "], lambda x: x IS NOT NULL)"


@plan(WHOLE + f" SELECT source, event, {_ALL}[1] AS dominant, array_to_string({_ALL}, ',') AS categories FROM g WHERE len({_ALL}) > 0")
def l16_failure_classes(spark, sf):
    df = whole_events(spark, sf).withColumn("c", lg.failure_classes(F.col("text"))).where(F.size("c") > 0)
    return df.select("source", "event", F.col("c")[0].alias("dominant"), F.array_join("c", ",").alias("categories"))


_SUBJ = " UNION ALL ".join(f"SELECT source, category, regexp_replace(trim(regexp_extract(text, {quoted(p)}, {g})), '(\\.class)+$', '') AS x FROM c WHERE category = '{n}'" for n, p, g in lg.SUBJECTS)


@plan(f"""WITH c AS (SELECT source, text, {_ALL}[1] AS category FROM ({LINES}) l), s AS ({_SUBJ})
  SELECT DISTINCT source, category, CASE WHEN contains(x, '/') THEN replace(x, '/', '.') WHEN contains(x, '.') AND regexp_matches(x, '^[a-z]') THEN x ELSE lower(x) END AS subject FROM s WHERE x <> ''""")
def l17_attribution(spark, sf):
    return lg.attributed(lines(spark, sf))


_GONE = "CASE " + " ".join(f"WHEN regexp_matches(text, {quoted(p)}) THEN {{'engine': '{e}', 'kind': '{k}', 'via': '{v}', 'id': lower(regexp_extract(text, {quoted(p)}, 1))}}" for e, k, v, p in lg.REMOVALS) + " END"


@plan(f"SELECT source, line_no, r.engine AS engine, r.kind AS kind, r.via AS via, r.id AS id FROM (SELECT source, line_no, {_GONE} AS r FROM ({LINES}) l) x WHERE r IS NOT NULL")
def l18_script_removals(spark, sf):
    return lg.removals(lines(spark, sf))


@plan(WHOLE + f""", tt AS (SELECT source, event, len(regexp_extract_all(text, '{_CHAIN}', 1)) > 0 AS x, level, CASE WHEN level = 'FATAL' THEN 'fatal' WHEN event % 3 = 0 THEN 'background' WHEN event % 3 = 1 THEN 'unknown' END AS term FROM g),
  lb AS (SELECT source, event, CASE WHEN term = 'fatal' AND x THEN 'causal' WHEN term = 'unknown' AND x THEN 'unknown' WHEN level IN ('ERROR', 'FATAL') AND coalesce(term, '') <> 'background' THEN 'contributing' ELSE 'background' END AS label FROM tt)
  SELECT source, event, label, CAST(CASE label WHEN 'causal' THEN 100 WHEN 'contributing' THEN 65 WHEN 'unknown' THEN 40 ELSE 15 END AS INT) AS score FROM lb""")
def l19_relevance(spark, sf):
    df = whole_events(spark, sf)
    term = F.when(F.col("level") == "FATAL", "fatal").when(F.col("event") % 3 == 0, "background").when(F.col("event") % 3 == 1, "unknown")
    r = lg.relevance(F.size(lg.chain(F.col("text"))) > 0, term, F.col("level"))
    return df.select("source", "event", r.alias("r")).select("source", "event", "r.label", "r.score")
