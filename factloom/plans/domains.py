"""Dependency, trust, overlap, performance and evaluation queries over facts made from the
supplied tables' keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.model import view
from factloom.operators import deps as d
from factloom.operators import evaluate as ev
from factloom.operators import overlap as o
from factloom.operators import perf as p
from factloom.operators import query as q
from factloom.operators import trust as t
from factloom.plans.base import Plans

plan = Plans()

# Dependencies -------------------------------------------------------------------------------

MODS = "SELECT 'm' || CAST(s_suppkey AS STRING) AS id, CAST(1 + s_nationkey % 3 AS STRING) || '.' || CAST(s_suppkey % 5 AS STRING) || '.0' AS version, 'f' || CAST(s_suppkey AS STRING) || '.jar' AS file FROM supplier WHERE s_suppkey % 4 <> 0"
PROVIDED = "SELECT 'alias' || CAST(s_suppkey % 9 AS STRING) AS id, 'm' || CAST(s_suppkey AS STRING) AS provider, '2.0.0' AS version FROM supplier WHERE s_suppkey % 4 = 1"
PROVIDERS = f"SELECT id, id AS provider, version FROM ({MODS}) m UNION SELECT id, provider, version FROM ({PROVIDED}) p"
DECLARED = """SELECT DISTINCT 'm' || CAST(l_suppkey AS STRING) AS id, CASE WHEN l_partkey % 10 = 0 THEN 'platform' WHEN l_partkey % 7 = 0 THEN 'alias' || CAST(l_partkey % 12 AS STRING) ELSE 'm' || CAST(l_partkey % 997 AS STRING) END AS dep,
  CASE l_linenumber WHEN 1 THEN '>=1.2.0' WHEN 2 THEN '[1.0,2.0)' WHEN 3 THEN '=2.0.0' WHEN 4 THEN 'weird' WHEN 5 THEN '^1.1' ELSE '*' END AS range, CASE l_linenumber WHEN 2 THEN 'maven' WHEN 4 THEN 'opaque' ELSE 'semver' END AS dialect,
  CASE l_returnflag WHEN 'A' THEN 'breaks' WHEN 'N' THEN 'requires' ELSE 'discourages' END AS relation, l_linestatus = 'O' AS mandatory FROM lineitem"""
IMPLICIT = "SELECT DISTINCT 'm' || CAST(l_suppkey AS STRING) AS id, 'm' || CAST((l_partkey + l_linenumber) % 997 AS STRING) AS dep, CAST(NULL AS BOOLEAN) AS mandatory FROM lineitem"


def v(spark, sf, *sqls):
    out = [view(spark, sf, s) for s in sqls]
    return out[0] if len(out) == 1 else out


@plan(f"SELECT id, dep, mandatory, 'declared' AS origin FROM ({DECLARED}) d UNION SELECT id, dep, coalesce(mandatory, false), 'implicit' FROM ({IMPLICIT}) i")
def d1_effective_model(spark, sf):
    return d.model(*v(spark, sf, MODS, PROVIDED, DECLARED, IMPLICIT))[1]


@plan(f"""SELECT id, dep, CASE WHEN dep = 'm0' THEN 'warn' WHEN dialect = 'opaque' THEN 'note' ELSE 'error' END AS severity FROM ({DECLARED}) d
  WHERE mandatory AND relation = 'requires' AND dep <> 'platform' AND dep NOT IN (SELECT id FROM ({PROVIDERS}) p)""")
def d2_missing(spark, sf):
    plausible = spark.createDataFrame([("m0",)], "id string")
    return d.missing(*v(spark, sf, DECLARED, PROVIDERS), ["platform"], plausible)


#: Each range's meaning for versions of three numbers, spelt out for the engine without it.
FITS = """CASE range WHEN '*' THEN true WHEN '>=1.2.0' THEN version >= '1.2.0' WHEN '[1.0,2.0)' THEN version >= '1.0.0' AND version < '2.0.0' WHEN '=2.0.0' THEN version = '2.0.0' WHEN '^1.1' THEN version >= '1.1.0' AND version < '2.0.0' END"""
MET = f"SELECT d.*, p.provider, p.version, {FITS} AS fits FROM ({DECLARED}) d JOIN ({PROVIDERS}) p ON d.dep = p.id"
@plan(f"SELECT id, dep, version, range, fits FROM ({MET}) m")
def d3_version_in_range(spark, sf):
    return d.met_versions(*v(spark, sf, DECLARED, PROVIDERS)).select("id", "dep", "version", "range", "fits")


_VERSION = f"""SELECT id, dep, provider, version, kind, CASE kind WHEN 'wrong-version' THEN CASE WHEN mandatory THEN 'error' ELSE 'warn' END WHEN 'incompatible' THEN CASE WHEN fits IS NULL THEN 'warn' ELSE 'error' END ELSE 'warn' END AS severity, provider <> dep AS via_alias
  FROM (SELECT *, CASE WHEN relation = 'requires' AND fits = false THEN 'wrong-version' WHEN relation = 'breaks' AND coalesce(fits, true) THEN 'incompatible' WHEN relation = 'discourages' AND coalesce(fits, true) THEN 'discouraged' END AS kind FROM ({MET}) m) x WHERE kind IS NOT NULL"""


def _version(name, where, kinds=d.KINDS, via_alias=None):
    @plan(f"SELECT * FROM ({_VERSION}) y WHERE {where}", name)
    def query(spark, sf):
        return d.version_findings(*v(spark, sf, DECLARED, PROVIDERS), kinds, via_alias)


_version("d4_wrong_version", "kind = 'wrong-version' and not via_alias", d.KINDS[:1], False)
_version("d5_incompatible", "kind <> 'wrong-version'", d.KINDS[1:])
_version("d6_provided_version", "via_alias", via_alias=True)


@plan(f"""SELECT DISTINCT i.id, i.dep FROM ({IMPLICIT}) i WHERE i.dep IN (SELECT id FROM ({PROVIDERS}) p) AND NOT EXISTS (SELECT 1 FROM ({DECLARED}) d WHERE d.id = i.id AND d.dep = i.dep)
  AND NOT EXISTS (SELECT 1 FROM ({DECLARED}) d JOIN ({PROVIDERS}) a ON d.dep = a.id JOIN ({PROVIDERS}) b ON a.provider = b.provider WHERE d.id = i.id AND b.id = i.dep)""")
def d7_undisclosed(spark, sf):
    i, e, pr = v(spark, sf, IMPLICIT, DECLARED, PROVIDERS)
    return d.undisclosed(i, e, pr)


_SHAPE = "CASE range WHEN '*' THEN 'unconstrained' WHEN '>=1.2.0' THEN 'unbounded-above' WHEN '=2.0.0' THEN 'exact' ELSE 'other' END"


@plan(f"SELECT id, dep, range, {_SHAPE} AS shape FROM ({DECLARED}) d")
def d8_range_shape(spark, sf):
    return d.range_shapes(v(spark, sf, DECLARED)).select("id", "dep", "range", "shape")


@plan(f"SELECT id, dep, CASE {_SHAPE} WHEN 'exact' THEN 'too-narrow' ELSE 'too-wide' END AS kind FROM ({DECLARED}) d WHERE relation = 'requires' AND {_SHAPE} <> 'other' AND dep IN (SELECT id FROM ({PROVIDERS}) p)")
def d9_loose_and_tight(spark, sf):
    return d.loose_and_tight(*v(spark, sf, DECLARED, PROVIDERS))


USES = "SELECT DISTINCT 'm' || CAST(l_suppkey AS STRING) AS id, 'm' || CAST(l_partkey * 3 % 997 AS STRING) AS dep FROM lineitem"


@plan(f"SELECT id, dep, truncated FROM ({DECLARED}) d, (SELECT false AS truncated) w WHERE mandatory AND relation = 'requires' AND dep IN (SELECT id FROM ({MODS}) m) AND (id, dep) NOT IN (SELECT id, dep FROM ({IMPLICIT}) i) AND (id, dep) NOT IN (SELECT id, dep FROM ({USES}) u)")
def d10_unused(spark, sf):
    e, m, i, u = v(spark, sf, DECLARED, MODS, IMPLICIT, USES)
    each = [d.unused(e, m, i, u, cut).withColumn("truncated", F.lit(cut)) for cut in (False, True)]
    return each[0].unionByName(each[1])


REFS = """SELECT 'w' || CAST(l_suppkey % 20 AS STRING) AS writer, 'ns' || CAST(l_partkey % 23 AS STRING) AS namespace, l_linestatus = 'O' AS required, l_returnflag = 'R' AS hard, l_tax > 0.05 AS conditional,
  'p' || CAST(l_partkey AS STRING) AS path, CASE l_linenumber % 2 WHEN 0 THEN 'item' ELSE 'block' END AS kind, 'n' || CAST(l_partkey AS STRING) || '_' || CAST(l_suppkey % 3 AS STRING) AS name FROM lineitem"""
OWNERS = "SELECT DISTINCT 'w' || CAST(s_suppkey % 20 AS STRING) AS writer, 'ns' || CAST(s_suppkey % 20 % 11 AS STRING) AS namespace FROM supplier"
_STATE = f"""SELECT namespace, CASE WHEN namespace IN (SELECT namespace FROM ({OWNERS}) o) THEN 'present' WHEN namespace = 'ns12' THEN 'via-alias' WHEN namespace = 'ns13' THEN 'builtin' WHEN namespace = 'ns14' THEN 'common' WHEN bool_or(required) THEN 'required-missing' ELSE 'optional-missing' END AS state FROM ({REFS}) r GROUP BY namespace"""


def states(spark, sf):
    alias = spark.createDataFrame([("ns12",)], "namespace string")
    return d.namespace_state(*v(spark, sf, REFS, OWNERS), alias, ["ns13"], ["ns14"])


@plan(_STATE)
def d11_namespaces(spark, sf):
    return states(spark, sf)


@plan(f"SELECT namespace, count(*) AS refs, bool_or(required) AS required, bool_or(hard) AS hard, min(path) AS sample FROM ({REFS}) r GROUP BY namespace")
def d12_implicit_namespaces(spark, sf):
    return d.implicit_by_namespace(v(spark, sf, REFS))


@plan(f"SELECT writer, namespace, count(*) AS refs FROM ({REFS}) r WHERE (writer, namespace) NOT IN (SELECT writer, namespace FROM ({OWNERS}) o) GROUP BY writer, namespace")
def d13_implicit_edges(spark, sf):
    return d.implicit_edges(*v(spark, sf, REFS, OWNERS))


_SAMPLE = "CASE WHEN count(DISTINCT {c}) > {n} THEN string_agg(DISTINCT {c}, ', ' ORDER BY {c}) FILTER (WHERE r <= {n}) || ' (+' || CAST(count(DISTINCT {c}) - {n} AS STRING) || ' more)' ELSE string_agg(DISTINCT {c}, ', ' ORDER BY {c}) END"


@plan(f"WITH s AS ({_STATE}), x AS (SELECT r.namespace, writer, dense_rank() OVER (PARTITION BY r.namespace ORDER BY writer) AS r FROM ({REFS}) r JOIN s ON r.namespace = s.namespace WHERE state = 'required-missing') SELECT namespace, {_SAMPLE.format(c='writer', n=3)} AS writers FROM x GROUP BY namespace")
def d14_implicit_missing(spark, sf):
    return d.implicit_missing(states(spark, sf), v(spark, sf, REFS))


DEFINED = f"SELECT DISTINCT namespace || '/' || kind || '/' || name || '.json' AS path FROM ({REFS}) r WHERE hard"
_DANGLING = f"SELECT writer, namespace, namespace || '/' || kind || '/' || name || '.json' AS path FROM ({REFS}) r WHERE required AND NOT conditional AND namespace IN (SELECT namespace FROM ({OWNERS}) o) AND namespace || '/' || kind || '/' || name || '.json' NOT IN (SELECT path FROM ({DEFINED}) d)"


def dangling(spark, sf):
    refs, defined, own = v(spark, sf, REFS, DEFINED, OWNERS)
    return d.dangling(refs, defined, own)


@plan(_DANGLING)
def d15_dangling(spark, sf):
    return dangling(spark, sf)


@plan(f"WITH x AS (SELECT g.writer, path, CASE WHEN o.writer IS NULL THEN 'cross' ELSE 'internal' END AS side FROM ({_DANGLING}) g LEFT JOIN ({OWNERS}) o ON g.writer = o.writer AND g.namespace = o.namespace), y AS (SELECT *, dense_rank() OVER (PARTITION BY writer, side ORDER BY path) AS r FROM x) SELECT writer, side, count(DISTINCT path) AS n, {_SAMPLE.format(c='path', n=6)} AS sample FROM y GROUP BY writer, side")
def d16_dangling_summary(spark, sf):
    return d.dangling_summary(dangling(spark, sf), v(spark, sf, OWNERS))


VOTES = "SELECT 'a' || CAST(l_orderkey % 40 AS STRING) AS artifact, 'one' AS loader, '1.' || CAST((l_orderkey % 40) % 7 % 5 AS STRING) AS version FROM lineitem"


@plan(f"WITH v AS ({VOTES}), n AS (SELECT version, count(*) AS c FROM (SELECT artifact, max(version) AS version FROM v GROUP BY artifact HAVING count(DISTINCT version) = 1) x GROUP BY version), m AS (SELECT * FROM n WHERE c = (SELECT max(c) FROM n)) SELECT 'one' AS loader, CASE WHEN count(*) = 1 AND max(c) >= 2 THEN max(version) END AS version FROM m")
def d17_environment(spark, sf):
    return d.environment(v(spark, sf, VOTES))


DIVIDED = f"SELECT artifact, CASE WHEN artifact = 'a3' THEN 'two' ELSE loader END AS loader, CASE WHEN artifact IN ('a1', 'a2') THEN '1.9' ELSE '1.' || CAST(length(artifact) AS STRING) END AS version FROM ({VOTES}) v WHERE artifact IN ('a1', 'a2', 'a3', 'a4', 'a5')"


@plan(f"WITH v AS ({DIVIDED}), n AS (SELECT version, count(DISTINCT artifact) AS c FROM v GROUP BY version), m AS (SELECT * FROM n WHERE c = (SELECT max(c) FROM n)) SELECT (SELECT CASE WHEN count(DISTINCT loader) = 1 THEN max(loader) END FROM v) AS loader, CASE WHEN count(*) = 1 AND max(c) >= 2 THEN max(version) END AS version FROM m")
def d17_divided(spark, sf):
    """Votes that disagree on the loader, and agree on a version by most."""
    return d.environment(v(spark, sf, DIVIDED))


BUMPS = "SELECT DISTINCT 'm' || CAST(s_suppkey AS STRING) AS dep, '1.1.0' AS old, '2.0.0' AS new FROM supplier"


@plan(f"""SELECT id, dep, CASE WHEN range = 'weird' THEN 'undecidable' WHEN range IN ('[1.0,2.0)', '^1.1') THEN 'breaks' WHEN range IN ('>=1.2.0', '=2.0.0') THEN 'fixed' ELSE 'same' END AS effect FROM ({DECLARED}) d WHERE dep IN (SELECT dep FROM ({BUMPS}) b)""")
def r9_update_impact(spark, sf):
    return d.update_impact(*v(spark, sf, DECLARED, BUMPS))


# Trust --------------------------------------------------------------------------------------

SIGNALS = """SELECT 'a' || CAST(l_suppkey AS STRING) || '-' || CAST(l_partkey % 5 AS STRING) AS archive, CASE l_linenumber WHEN 1 THEN 'socket' WHEN 2 THEN 'process_spawn' WHEN 3 THEN 'reflection' WHEN 4 THEN 'unsafe' ELSE 'exit' END AS signal,
  l_returnflag = 'R' AS structural, CASE l_returnflag WHEN 'A' THEN 'reference' WHEN 'N' THEN 'call' ELSE 'reachable' END AS strength, CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE CAST(l_quantity AS INT) END AS affected, CAST(l_partkey % 4 AS INT) * 30 AS scanned FROM lineitem"""
_STR = "CASE strength WHEN 'reachable' THEN 2 WHEN 'call' THEN 1 ELSE 0 END"
_COLL = f"SELECT archive, signal, bool_or(structural) AS structural, max({_STR}) AS strength, max(affected) AS affected, max(scanned) AS scanned FROM ({SIGNALS}) s GROUP BY archive, signal"
_ROLL = f"SELECT archive, string_agg(signal, ',' ORDER BY signal) AS signals, max(strength) AS strength, max(affected) AS affected, max(scanned) AS scanned, count(*) FILTER (WHERE structural) AS structural, count(*) FILTER (WHERE NOT structural) AS corroborated, bool_or(signal IN ('process_spawn', 'unsafe')) AS risky, count(*) AS n FROM ({_COLL}) c GROUP BY archive"


@plan(f"SELECT archive, signals, strength, affected, structural, corroborated FROM ({_ROLL}) r")
def x1_signal_rollup(spark, sf):
    r = t.rollup(v(spark, sf, SIGNALS))
    return r.select("archive", F.array_join("signals", ",").alias("signals"), "strength", "affected", "structural", "corroborated")


@plan(f"SELECT archive, CASE WHEN risky THEN 'warn' ELSE 'note' END AS severity FROM ({_ROLL}) r WHERE risky OR n >= 2")
def x2_emission(spark, sf):
    return t.emitted(t.rollup(v(spark, sf, SIGNALS))).select("archive", "severity")


@plan(f"SELECT archive, round(greatest(0.35, least(0.98, CAST(0.55 AS DOUBLE) + CAST(0.14 AS DOUBLE) * structural / n + CASE strength WHEN 2 THEN CAST(0.12 AS DOUBLE) WHEN 1 THEN 0.06 ELSE 0 END + CASE WHEN scanned > 0 THEN CAST(0.12 AS DOUBLE) * least(1.0, affected / CAST(scanned AS DOUBLE)) ELSE 0 END - CASE WHEN affected = 1 AND scanned > 64 THEN CAST(0.05 AS DOUBLE) ELSE 0 END - CAST(0.1 AS DOUBLE) * corroborated / n - CASE WHEN structural = 0 THEN CAST(0.08 AS DOUBLE) ELSE 0 END)), 6) AS confidence FROM ({_ROLL}) r")
def x3_confidence(spark, sf):
    return t.rollup(v(spark, sf, SIGNALS)).select("archive", F.round(t.confidence(), 6).alias("confidence"))


@plan(f"SELECT archive, signal, structural, strength FROM ({_COLL}) c")
def x4_collapse(spark, sf):
    return t.collapsed(v(spark, sf, SIGNALS)).select("archive", "signal", "structural", "strength")


TRUST = "SELECT 'a' || CAST(s_suppkey AS STRING) || '-' || CAST(s_nationkey % 5 AS STRING) AS archive, s_suppkey % 2 = 0 AS has_id, s_suppkey % 3 = 0 AS has_version, s_nationkey % 2 = 0 AS has_loader, s_nationkey % 3 = 0 AS has_platform, s_acctbal > 0 AS has_contact, s_acctbal > 5000 AS has_lock, s_suppkey % 7 = 0 AS has_signature FROM supplier"
_SCORE = "CAST(least(100, 20 + " + " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in t.TRUST) + ") AS INT)"


@plan(f"SELECT archive, {_SCORE} AS score FROM ({TRUST}) t")
def x5_trust_score(spark, sf):
    return v(spark, sf, TRUST).select("archive", t.trust_score().alias("score"))


@plan(f"SELECT CASE WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n FROM (SELECT {_SCORE} AS score FROM ({TRUST}) t) s GROUP BY 1")
def x6_trust_buckets(spark, sf):
    return v(spark, sf, TRUST).groupBy(t.bucket(t.trust_score()).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@plan(f"SELECT s.archive, coalesce(score, 0) AS score, string_agg(DISTINCT signal, ',' ORDER BY signal) AS capabilities FROM ({SIGNALS}) s LEFT JOIN (SELECT archive, {_SCORE} AS score FROM ({TRUST}) t) t ON s.archive = t.archive WHERE signal IN ('process_spawn', 'unsafe') AND coalesce(score, 0) < 60 GROUP BY 1, 2")
def x7_low_trust(spark, sf):
    return t.low_trust_capabilities(v(spark, sf, SIGNALS), v(spark, sf, TRUST).select("archive", t.trust_score().alias("score")))


@plan(f"SELECT archive, signal, count(*) AS n FROM ({SIGNALS}) s GROUP BY archive, signal")
def x8_capability_rollup(spark, sf):
    return t.capability_counts(v(spark, sf, SIGNALS))


@plan(f"SELECT archive, CASE WHEN NOT has_id THEN 'unknown-source' ELSE 'unsigned-jar' END AS rule_id FROM ({TRUST}) t WHERE NOT has_id OR NOT has_signature")
def x9_provenance(spark, sf):
    return t.provenance_gaps(v(spark, sf, TRUST))


@plan("""WITH l AS (SELECT o_orderstatus, h || ':' || count(*) AS d, substr(h, 1, 4) AS p FROM (SELECT o_orderstatus, sha256(CAST(o_orderkey AS STRING) || chr(31) || o_orderpriority || chr(31) || CAST(o_custkey AS STRING)) AS h FROM orders) GROUP BY o_orderstatus, h),
  a AS (SELECT o_orderstatus, p || '=' || sha256(string_agg(d, '' ORDER BY d)) AS d, substr(p, 1, 2) AS p FROM l GROUP BY o_orderstatus, l.p),
  b AS (SELECT o_orderstatus, p || '=' || sha256(string_agg(d, '' ORDER BY d)) AS d FROM a GROUP BY o_orderstatus, a.p)
  SELECT o_orderstatus, sha256(string_agg(d, '' ORDER BY d)) AS digest FROM b GROUP BY o_orderstatus""")
def x10_lock_digest(spark, sf):
    rows = v(spark, sf, "SELECT o_orderstatus, CAST(o_orderkey AS STRING) AS id, o_orderpriority AS version, CAST(o_custkey AS STRING) AS file FROM orders")
    return t.lock_digest(rows, ["o_orderstatus"])


# Overlaps -----------------------------------------------------------------------------------

SITES = """SELECT (l_orderkey * 100000 + l_partkey) * 10 + l_linenumber AS id, 'm' || CAST(l_suppkey AS STRING) AS mod, 'pkg' || CAST(l_partkey % 4 AS STRING) || '.T' || CAST(l_partkey AS STRING) AS target, 'f' || CAST(l_linenumber % 3 AS STRING) AS method, 's' || CAST(l_partkey % 2 AS STRING) AS site,
  CASE l_linenumber WHEN 1 THEN 'replace' WHEN 2 THEN 'wrap' WHEN 3 THEN 'transform' WHEN 4 THEN 'guard' ELSE 'observe' END AS operation, CASE l_returnflag WHEN 'A' THEN 'client' WHEN 'R' THEN 'server' ELSE 'both' END AS side,
  l_tax > 0.06 AS hot, CAST(l_quantity AS INT) AS confidence, CAST(l_quantity AS INT) % 3 AS priority, CAST(l_suppkey % 3 AS STRING) AS descriptor FROM lineitem"""


def sites(spark, sf):
    return v(spark, sf, SITES)


@plan(f"""WITH s AS ({SITES}), m AS (SELECT target, bool_or(c > 1 OR e > 1) AS method_conflict FROM (SELECT target, method, count(DISTINCT CASE WHEN side IN ('client', 'both') THEN mod END) AS c, count(DISTINCT CASE WHEN side IN ('server', 'both') THEN mod END) AS e FROM s GROUP BY target, method) x GROUP BY target)
  SELECT s.target, count(DISTINCT mod) AS mods, string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations, bool_or(hot) AS hot, bool_or(method_conflict) AS method_conflict FROM s JOIN m ON s.target = m.target GROUP BY s.target HAVING count(DISTINCT mod) >= 2""")
def o1_target_overlap(spark, sf):
    return o.overlaps(sites(spark, sf))


@plan(f"WITH s AS ({SITES}), c AS (SELECT DISTINCT mod AS class, target, method FROM s WHERE operation = 'replace'), e AS (SELECT target, method, min(side) AS effect FROM s WHERE hot GROUP BY 1, 2) SELECT c.target, c.method, class, effect FROM c LEFT JOIN e ON c.target = e.target AND c.method = e.method")
def o2_overwrites(spark, sf):
    s = sites(spark, sf)
    c = s.where("operation = 'replace'").select(F.col("mod").alias("class"), F.array("target").alias("targets"), F.array("method").alias("methods"))
    return o.overwrites(c, s.where("hot").select("target", "method", F.col("side").alias("effect")))


def _pairs(name, keys, differ):
    on = " AND ".join([f"a.{k} = b.{k}" for k in keys] + ["a.id < b.id"] + [f"a.{c} <> b.{c}" for c in ["mod", *differ]])

    @plan(f"WITH s AS ({SITES}) SELECT {', '.join('a.' + k for k in keys)}, a.id AS a, b.id AS b FROM s a JOIN s b ON {on}", name)
    def query(spark, sf):
        return o.pairs(sites(spark, sf), list(keys), list(differ))


#: Sites under ids of their own.
SINGLE = f"SELECT id, {', '.join(f'min({c}) AS {c}' for c in ('mod', 'target', 'method', 'site', 'priority', 'descriptor'))} FROM ({SITES}) s GROUP BY id"


def single(spark, sf):
    """SINGLE, grouped after rows are dealt by id: the least of a text is found by sorting, of a task's
    share of ids and not of a whole input split, where few ids come twice."""
    cols = ("mod", "target", "method", "site", "priority", "descriptor")
    return sites(spark, sf).select("id", *cols).repartition("id").groupBy("id").agg(*[F.min(c).alias(c) for c in cols])


def _pair_counts(name, keys, differ):
    by, same = ", ".join(keys), " AND ".join(f"a.{k} = b.{k}" for k in keys)
    unlike = " AND ".join(f"a.{c} <> b.{c}" for c in ["mod", *differ])

    @plan(f"""WITH s AS ({SINGLE}), p AS (SELECT {", ".join("a." + k for k in keys)}, count(*) AS n_pairs FROM s a JOIN s b ON {same} AND a.id < b.id AND {unlike} GROUP BY ALL),
  n AS (SELECT {by}, count(*) AS n_sites, count(DISTINCT {" || '/' || ".join(["mod", *(f"CAST({c} AS STRING)" for c in differ)])}) AS n_classes FROM s GROUP BY ALL) SELECT {by}, n_sites, n_classes, n_pairs FROM n JOIN p USING ({by})""", name)
    def query(spark, sf):
        return o.pair_counts(o.pair_classes(single(spark, sf), list(keys), list(differ)), list(keys), list(differ))


_pair_counts("o3_pair_counts", ("target", "method", "site"), ())
_pair_counts("o4_pair_counts", ("target", "method"), ("priority",))
_pair_counts("o5_pair_counts", ("target", "method"), ("descriptor",))
_pairs("o3_same_call_pairs", ("target", "method", "site"), ())
_pairs("o4_priority_pairs", ("target", "method"), ("priority",))
_pairs("o5_signature_pairs", ("target", "method"), ("descriptor",))

_COMP = f"""SELECT target, site, count(*) AS n, CASE WHEN bool_or(side = 'client') AND bool_or(side = 'server') AND count(*) = 2 THEN 'impossible'
  WHEN count(*) FILTER (WHERE operation = 'replace') >= 2 OR (count(*) FILTER (WHERE operation = 'replace') >= 1 AND count(*) FILTER (WHERE operation NOT IN ('replace', 'observe')) > 0) THEN 'high'
  WHEN count(*) FILTER (WHERE operation = 'wrap') >= 2 OR count(*) FILTER (WHERE operation = 'transform') >= 2 THEN 'order-sensitive' WHEN count(*) FILTER (WHERE operation = 'guard') >= 1 THEN 'conditional' ELSE 'safe' END AS class,
  string_agg(CAST(id AS STRING), ',' ORDER BY priority DESC, id) AS participants FROM ({SITES}) s GROUP BY target, site"""


@plan(_COMP)
def o6_composition(spark, sf):
    return o.composition(sites(spark, sf).withColumnRenamed("operation", "kind"))


_W = "CASE class WHEN 'high' THEN 4 WHEN 'order-sensitive' THEN 3 WHEN 'conditional' THEN 2 WHEN 'impossible' THEN 1 ELSE 0 END"


@plan(f"""WITH s AS ({SITES}), w AS (SELECT target, max({_W}) AS w FROM ({_COMP}) c GROUP BY target), f AS (SELECT target, count(*) AS failures FROM s WHERE confidence > 47 GROUP BY target)
  SELECT s.target, coalesce(failures, 0) AS failures, CASE w WHEN 4 THEN 'high' WHEN 3 THEN 'order-sensitive' WHEN 2 THEN 'conditional' WHEN 1 THEN 'impossible' ELSE 'safe' END AS worst, min(confidence) AS confidence,
  CASE WHEN coalesce(failures, 0) > 0 THEN 'confirmed' WHEN w = 4 THEN 'conflict' ELSE 'overlap' END AS kind FROM s JOIN w ON s.target = w.target LEFT JOIN f ON s.target = f.target GROUP BY s.target, failures, w""")
def o7_risk_clusters(spark, sf):
    s = sites(spark, sf)
    return o.clusters(s.withColumnRenamed("operation", "kind"), s.where("confidence > 47"))


SCORED = """SELECT p_partkey AS id, p_size % 5 = 0 AS overwrite, p_size % 3 = 0 AS method_conflict, p_size % 2 = 0 AS hot, p_partkey % 2 = 0 AS skew, p_partkey % 3 = 0 AS reflection, p_partkey % 5 = 0 AS hard_capture, p_partkey % 7 = 0 AS inherited,
  p_partkey % 11 = 0 AS gated, p_size % 7 = 0 AS returns, p_size % 11 = 0 AS advanced, p_partkey % 13 = 0 AS loader, p_partkey % 4 = 0 AS priority, p_partkey % 9 = 0 AS complex,
  CASE p_size % 9 WHEN 0 THEN 'method-replace' WHEN 1 THEN 'call-replace' WHEN 2 THEN 'entry-hook' WHEN 3 THEN 'exit-hook' WHEN 4 THEN 'local-mutation' WHEN 5 THEN 'data-mutation' WHEN 6 THEN 'constant-mutation' WHEN 7 THEN 'other' END AS injection,
  CASE p_partkey % 8 WHEN 0 THEN 'networking' WHEN 1 THEN 'class-loading' WHEN 2 THEN 'serialization' WHEN 3 THEN 'rendering' WHEN 4 THEN 'server-tick' WHEN 5 THEN 'persistence' WHEN 6 THEN 'other' END AS subsystem,
  p_size % 4 AS effects, 1 + p_size % 5 AS mods, p_size % 3 AS edges, p_size % 4 AS unresolved, p_partkey % 17 = 0 AS failed, p_size % 2 = 1 AS confirmed FROM part"""
_I = "least(40, CASE WHEN overwrite THEN 40 WHEN method_conflict THEN 24 ELSE 8 END + CASE WHEN injection IS NULL THEN 0 ELSE least(16, CASE injection WHEN 'method-replace' THEN 25 WHEN 'call-replace' THEN 20 WHEN 'entry-hook' THEN 15 WHEN 'exit-hook' THEN 12 WHEN 'local-mutation' THEN 10 WHEN 'data-mutation' THEN 10 WHEN 'constant-mutation' THEN 8 ELSE 5 END) END + CASE WHEN returns THEN 8 ELSE 0 END + CASE WHEN advanced THEN 6 ELSE 0 END)"
_B = "least(30, CASE WHEN hot THEN 18 + least(3 * effects, 6) ELSE 0 END + least(3 * (mods - 1), 9) + least(2 * edges, 6) + CASE WHEN loader THEN 8 ELSE 0 END + CASE WHEN subsystem IN ('networking', 'class-loading', 'serialization') THEN 6 WHEN subsystem IN ('rendering', 'server-tick', 'persistence') THEN 4 ELSE 0 END)"
_FR = "least(30, CASE WHEN skew THEN 14 ELSE 0 END + CASE WHEN reflection THEN 8 ELSE 0 END + CASE WHEN hard_capture THEN 8 ELSE 0 END + CASE WHEN priority THEN 6 ELSE 0 END + CASE WHEN inherited THEN 5 ELSE 0 END + CASE WHEN complex THEN 4 ELSE 0 END)"
_CE = "greatest(20, 100 - least(25 * unresolved, 60) - CASE WHEN NOT method_conflict AND NOT overwrite THEN 20 ELSE 0 END - CASE WHEN gated THEN 25 ELSE 0 END)"
_RISK = f"CAST(floor(CAST({_CE} AS DOUBLE) / 100 * (CAST(0.5 AS DOUBLE) * floor(CAST(2.5 AS DOUBLE) * {_I} + CAST(0.5 AS DOUBLE)) + CAST(0.3 AS DOUBLE) * {_B} / 30 * 100 + CAST(0.2 AS DOUBLE) * {_FR} / 30 * 100) + CAST(0.5 AS DOUBLE)) AS INT)"


@plan(f"SELECT id, {_RISK} AS score, CAST(CASE WHEN failed AND confirmed THEN greatest({_RISK}, 90) WHEN failed THEN greatest({_RISK}, 55) ELSE {_RISK} END AS INT) AS with_failures FROM ({SCORED}) s")
def o8_risk_score(spark, sf):
    score = v(spark, sf, SCORED).select("id", "failed", "confirmed", o.risk_score().alias("score"))
    return score.select("id", "score", o.floored(F.col("score"), F.col("failed"), F.col("confirmed")).alias("with_failures"))


COMPLEX = "SELECT 'm' || CAST(p_partkey AS STRING) AS mod, p_size * 3 AS peak, p_size % 9 AS classes, p_size AS targets, p_size * 2 AS sites, p_size % 7 AS conflicts, p_size % 2 = 0 AS hot, p_size % 6 AS inert, 6 AS total, p_size * 30 AS volume FROM part"


@plan(f"SELECT mod, CAST(least(100, least(peak // 2, 40) + least(classes * 2, 16) + least(targets, 20) + least(sites // 2, 14) + least(conflicts * 4, 20) + CASE WHEN hot THEN 6 ELSE 0 END) AS INT) AS complexity FROM ({COMPLEX}) c")
def o9_complexity(spark, sf):
    return o.complexity(v(spark, sf, COMPLEX))


@plan(f"SELECT mod, CAST(least((inert * 100 // total) // 2, 50) + least(inert * 4, 30) + least(volume // 40, 20) AS INT) AS bloat FROM ({COMPLEX}) c WHERE inert > 0")
def o10_bloat(spark, sf):
    return o.bloat(v(spark, sf, COMPLEX))


CLAIMS = """SELECT p_partkey AS id, p_size % 3 > 0 AS failure, p_partkey % 2 = 0 AS conclusive, p_size * 2 AS impact, CASE p_size % 9 WHEN 0 THEN 'runtime-confirmed' WHEN 1 THEN 'static-exact' WHEN 2 THEN 'static-descriptor-aware' WHEN 3 THEN 'static-name-only'
  WHEN 4 THEN 'heuristic-site' WHEN 5 THEN 'heuristic-class' WHEN 6 THEN 'heuristic-mod' ELSE 'unchecked' END AS confirmation FROM part"""


@plan(f"""SELECT id, CASE WHEN failure THEN CASE WHEN confirmation = 'runtime-confirmed' OR confirmation = 'static-exact' AND conclusive THEN 'error' WHEN starts_with(confirmation, 'static-') THEN 'warn'
  WHEN confirmation IN ('heuristic-site', 'heuristic-class') THEN 'note' ELSE 'info' END WHEN impact >= 80 THEN 'warn' WHEN impact >= 40 THEN 'note' ELSE 'info' END AS severity FROM ({CLAIMS}) c""")
def o11_recommended_severity(spark, sf):
    return v(spark, sf, CLAIMS).select("id", o.recommended_severity(F.col("failure"), F.col("confirmation"), F.col("conclusive"), F.col("impact")).alias("severity"))


FAILED = f"SELECT CASE WHEN id % 2 = 0 THEN target ELSE regexp_extract(target, '[A-Z][0-9]+$', 0) END AS class, CASE WHEN id % 3 = 0 THEN site END AS point, side AS config FROM ({SITES}) s WHERE confidence > 47"


@plan(f"WITH s AS ({SITES}), f AS ({FAILED}) SELECT s.id, coalesce(bool_or(s.side = f.config), false) AS strong FROM s JOIN f ON list_last(string_split(f.class, '.')) = split_part(s.target, '.', 2) AND (f.class = s.target OR NOT contains(f.class, '.')) AND (f.point IS NULL OR f.point = s.site) GROUP BY s.id")
def o12_confirmed_sites(spark, sf):
    s = sites(spark, sf).select("id", F.col("target").alias("class"), F.col("site").alias("point"), F.col("side").alias("config"))
    return o.confirmed(s, v(spark, sf, FAILED))


@plan("SELECT event_id AS fact_id, CAST(user_id AS STRING) AS target FROM events WHERE event_type = 'click' AND event_id % 7 > 2")
def o13_hot_view(spark, sf):
    from factloom.plans.core import events_view

    return events_view(spark, sf, "click", {"flag": "bool"}).where("flag").select("fact_id", F.col("subject").alias("target"))


LOADERS = f"SELECT id, CASE id % 4 WHEN 0 THEN 'TagLoader' WHEN 1 THEN 'RecipeManager' WHEN 2 THEN 'PackSource' ELSE 'World' END AS class, operation, confidence FROM ({SITES}) s"


@plan(f"SELECT id, CASE id % 4 WHEN 0 THEN 'tags' WHEN 1 THEN 'recipes' ELSE 'packs' END AS subsystem, CASE operation WHEN 'replace' THEN 'replaces' WHEN 'transform' THEN 'alters' ELSE 'observes' END AS effect, CAST(confidence - CASE WHEN confidence < 60 THEN 15 ELSE 0 END AS INT) AS confidence FROM ({LOADERS}) l WHERE id % 4 < 3")
def o14_resource_mutation(spark, sf):
    return o.resource_mutation(v(spark, sf, LOADERS))


# Performance --------------------------------------------------------------------------------

SPIKES = "SELECT event_id AS tick, CAST(floor(value * 2) AS BIGINT) AS ms FROM events WHERE event_type = 'purchase'"
HANDLERS = "SELECT 'm' || CAST(user_id % 30 AS STRING) AS mod, event_id % 9 = 0 AS heavy FROM events WHERE event_type = 'view'"
HOT = "SELECT 'm' || CAST(s_suppkey AS STRING) AS mod, CAST(s_nationkey * 3 AS DOUBLE) AS percent FROM supplier"
MENTIONS = "SELECT 'm' || CAST(user_id % 30 AS STRING) AS mod, CASE WHEN event_id % 3 > 0 THEN 'E' || CAST(event_id % 5 AS STRING) END AS exception FROM events WHERE event_type <> 'view'"


@plan(f"SELECT mod, count(*) AS handlers, (SELECT max(ms) FROM ({SPIKES}) s) AS worst, CASE WHEN bool_or(heavy) THEN 'warn' ELSE 'note' END AS severity FROM ({HANDLERS}) h GROUP BY mod")
def p1_spikes_and_handlers(spark, sf):
    return p.spikes_and_handlers(*v(spark, sf, SPIKES, HANDLERS))


@plan(f"SELECT h.mod, max(percent) AS percent, count(*) AS mentions, count(DISTINCT exception) AS exceptions FROM ({HOT}) h JOIN ({MENTIONS}) m ON h.mod = m.mod GROUP BY h.mod")
def p2_hot_mods_in_logs(spark, sf):
    return p.hot_mods_in_logs(*v(spark, sf, HOT, MENTIONS))


@plan(f"SELECT mod, count(*) AS mentions, (SELECT max(ms) FROM ({SPIKES}) s) AS worst FROM ({MENTIONS}) m WHERE mod IN (SELECT id FROM ({MODS}) i) GROUP BY mod")
def p3_spikes_and_mentions(spark, sf):
    s, m, i = v(spark, sf, SPIKES, MENTIONS, MODS)
    return p.spikes_and_mentions(s, m, i.select(F.col("id").alias("mod")))


METHODS = "SELECT p_partkey AS id, 'pkg' || CAST(p_partkey % 4 AS STRING) || '.T' || CAST(p_partkey AS STRING) AS class, 'f' || CAST(p_size % 3 AS STRING) AS method, CAST(p_size % 12 AS DOUBLE) AS percent FROM part"


@plan(f"""WITH h AS (SELECT * FROM ({METHODS}) m WHERE percent >= 5), s AS ({SITES}), m AS (SELECT h.id AS left_id, s.id AS right_id, operation, CASE WHEN h.class = s.target AND h.method = s.method THEN 'method' WHEN h.class = s.target THEN 'class' ELSE 'simple' END AS quality FROM h JOIN s ON split_part(h.class, '.', 2) = split_part(s.target, '.', 2))
  SELECT left_id, right_id, quality, CASE WHEN quality = 'method' AND operation = 'replace' THEN 'warn' ELSE 'note' END AS severity FROM m""")
def p4_hot_methods_patched(spark, sf):
    return p.hot_methods_patched(v(spark, sf, METHODS), sites(spark, sf).select("id", F.col("target").alias("class"), "method", "operation"))


@plan(f"SELECT mod, count(*) AS patches, (SELECT max(ms) FROM ({SPIKES}) s) AS worst, 'warn' AS severity FROM ({SITES}) s WHERE hot GROUP BY mod")
def p5_spikes_and_hot_paths(spark, sf):
    return p.spikes_and_hot_paths(v(spark, sf, SPIKES), sites(spark, sf))


COLLIDED = f"SELECT target AS path, 'm' || CAST(min(id) % 100 AS STRING) || ',' || 'm' || CAST(max(id) % 100 AS STRING) AS writers FROM ({SITES}) s GROUP BY target"


@plan(f"WITH w AS (SELECT DISTINCT path, unnest(string_split(writers, ',')) AS mod FROM ({COLLIDED}) c) SELECT h.mod, max(percent) AS percent, count(*) AS paths FROM ({HOT}) h JOIN w ON h.mod = w.mod GROUP BY h.mod")
def p6_hot_mods_in_collisions(spark, sf):
    return p.hot_mods_in_collisions(*v(spark, sf, HOT, COLLIDED))


SHIPPED = "SELECT 'm' || CAST(l_suppkey AS STRING) AS mod, CASE l_linenumber WHEN 1 THEN 'data/worldgen/' WHEN 2 THEN 'assets/model/' WHEN 3 THEN 'assets/atlas/' ELSE 'x/' END || CAST(l_partkey AS STRING) AS path FROM lineitem"


@plan(f"SELECT h.mod, CASE WHEN contains(path, 'worldgen') THEN 'worldgen' WHEN contains(path, 'atlas') THEN 'atlas' ELSE 'model' END AS category, count(*) AS n FROM ({HOT}) h JOIN ({SHIPPED}) s ON h.mod = s.mod WHERE NOT starts_with(path, 'x/') GROUP BY 1, 2")
def p7_hot_mods_by_category(spark, sf):
    return p.hot_mods_by_category(*v(spark, sf, HOT, SHIPPED))


EXCERPTS = f"SELECT id AS excerpt_id, 'slow call in ' || CASE id % 3 WHEN 0 THEN target || '.' || method WHEN 1 THEN target ELSE split_part(target, '.', 2) END || ' again' AS text FROM ({SITES}) s"


@plan(f"""WITH h AS (SELECT *, split_part(class, '.', 2) AS simple FROM ({METHODS}) m WHERE percent >= 5), e AS (SELECT *, string_split_regex(text, '[^\\w$]+') AS words FROM ({EXCERPTS}) e)
  SELECT DISTINCT id, excerpt_id, CASE WHEN contains(text, class || '.' || method) THEN 'method' WHEN contains(text, class) THEN 'class' ELSE 'simple' END AS how FROM h JOIN e ON list_contains(words, simple)""")
def p8_hot_methods_in_excerpts(spark, sf):
    return p.hot_methods_in_excerpts(*v(spark, sf, METHODS, EXCERPTS))


@plan("""WITH c AS (SELECT user_id % 2 AS run, event_type AS topic, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT DISTINCT user_id % 2 AS run FROM events WHERE event_type = 'purchase' AND user_id % 2 = 1)
  SELECT run, topic, n FROM c WHERE n >= 3 AND run NOT IN (SELECT run FROM p)""")
def p9_fallback_hints(spark, sf):
    """Of two runs one has profile rows, so that only the other one gives hints."""
    rows = v(spark, sf, "SELECT event_type AS topic, user_id % 2 AS run FROM events")
    each = []
    for run in (0, 1):
        own = rows.where(F.col("run") == run)
        hints = p.fallback_hints(own.where("topic = 'purchase' and run = 1"), own.groupBy("topic").agg(F.count(F.lit(1)).alias("n")))
        each.append(hints.select(F.lit(run).cast("long").alias("run"), "topic", "n"))
    return each[0].unionByName(each[1])


PROFILE = "SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 'cpu' ELSE 'tick_spike' END AS kind, value * 2 AS number FROM events"


@plan(f"SELECT id, kind, CASE WHEN kind = 'cpu' OR number >= 100 THEN 'warn' ELSE 'note' END AS severity FROM ({PROFILE}) p WHERE number >= 50")
def p10_thresholds(spark, sf):
    return p.over_threshold(v(spark, sf, PROFILE))


# Evaluation ---------------------------------------------------------------------------------

PRED = "SELECT 'd' || CAST(d.doc_id AS STRING) AS finding_id, CAST(d.doc_id % 400 AS STRING) AS case, CASE WHEN n_chars % 2 = 0 THEN 'low' ELSE 'toxic' END AS category, source || '.' || lang AS subject, 'rule' || CAST(n_chars % 6 AS STRING) AS rule_id, CAST(n_chars % 10 AS DOUBLE) / 10 AS confidence FROM documents d"
TRUE = "SELECT CAST(l.doc_id % 400 AS STRING) AS case, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'low' END AS category, CASE WHEN l.doc_id % 3 = 0 THEN upper(lang) ELSE source END AS subject FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
_CONF = f"""SELECT category, count(*) FILTER (WHERE p AND o) AS tp, count(*) FILTER (WHERE p AND NOT o) AS fp, count(*) FILTER (WHERE o AND NOT p) AS fn FROM (SELECT coalesce(a.category, b.category) AS category, a.category IS NOT NULL AS p, b.category IS NOT NULL AS o FROM (SELECT DISTINCT "case" AS c, category FROM ({PRED}) x) a FULL JOIN (SELECT DISTINCT "case" AS c, category FROM ({TRUE}) y) b ON a.c = b.c AND a.category = b.category) z GROUP BY category"""
_PR = "tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(tp + fn AS DOUBLE) AS recall"


def quoted(sql):
    return sql.replace(" AS case", ' AS "case"')


@plan(f"WITH c AS ({quoted(_CONF)}) SELECT category, tp, fp, fn, round(tp / CAST(tp + fp AS DOUBLE), 9) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 9) AS recall FROM c")
def e1_confusion(spark, sf):
    return ev.confusion(*v(spark, sf, PRED, TRUE)).select("category", "tp", "fp", "fn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


_N = "regexp_replace(lower(trim({})), '[-_\\s]+', '-', 'g')"
_S = "list_last(string_split_regex(" + _N + ", '[./]'))"
_MATCH = f"""SELECT DISTINCT p."case", p.category, p.subject AS a, t.subject AS b FROM ({quoted(PRED)}) p JOIN ({quoted(TRUE)}) t ON p."case" = t."case" AND p.category = t.category
  AND ({_N.format('p.subject')} = {_N.format('t.subject')} OR {_S.format('p.subject')} = {_S.format('t.subject')} OR contains({_N.format('p.subject')}, {_N.format('t.subject')}) OR contains({_N.format('t.subject')}, {_N.format('p.subject')}))"""
_ROWS = f"""SELECT finding_id, p."case", p.category, rule_id, m.b AS matched, CASE WHEN confidence < 0.3 THEN 'below-threshold' WHEN m.b IS NOT NULL THEN 'true-positive' ELSE 'false-positive' END AS outcome
  FROM ({quoted(PRED)}) p LEFT JOIN (SELECT "case", category, a, min(b) AS b FROM ({_MATCH}) x GROUP BY 1, 2, 3) m ON p."case" = m."case" AND p.category = m.category AND p.subject = m.a"""


def rows(spark, sf):
    return ev.finding_rows(*v(spark, sf, PRED, TRUE), 0.3)


@plan(f"""WITH r AS ({_ROWS}), n AS (SELECT rule_id, count(*) FILTER (WHERE outcome = 'true-positive') AS tp, count(*) FILTER (WHERE outcome = 'false-positive') AS fp FROM r GROUP BY rule_id),
  f AS (SELECT rule_id, count(*) AS fn FROM (SELECT DISTINCT rule_id, category FROM r) k JOIN (SELECT DISTINCT "case", category FROM ({quoted(TRUE)}) t) t ON k.category = t.category
    WHERE NOT EXISTS (SELECT 1 FROM r h WHERE h.outcome = 'true-positive' AND h.rule_id = k.rule_id AND h."case" = t."case" AND h.category = t.category) GROUP BY rule_id)
  SELECT n.rule_id, tp, fp, coalesce(fn, 0) AS fn FROM n LEFT JOIN f ON n.rule_id = f.rule_id""")
def e2_rule_accuracy(spark, sf):
    return ev.rule_accuracy(rows(spark, sf), v(spark, sf, TRUE))


@plan(f"SELECT finding_id, category, rule_id, matched, outcome FROM ({_ROWS}) r")
def e3_finding_rows(spark, sf):
    return rows(spark, sf).drop("case")


@plan(f"SELECT category, a, b FROM ({_MATCH}) m")
def e4_subject_match(spark, sf):
    a, b = v(spark, sf, PRED, TRUE)
    return ev.subject_matches(a.select("case", "category", "subject"), b).drop("case")


@plan("""WITH b AS (SELECT o_orderkey AS c, o_custkey % 50 AS k FROM orders), a AS (SELECT DISTINCT l_orderkey AS c, l_suppkey % 50 AS k FROM lineitem)
  SELECT count(*) AS blamed, count(a.c) AS "right", count(a.c) / CAST(count(*) AS DOUBLE) AS precision FROM b LEFT JOIN a ON a.c = b.c AND a.k = b.k""")
def e5_blame_precision(spark, sf):
    b = v(spark, sf, "SELECT o_orderkey AS case, o_custkey % 50 AS class FROM orders")
    return ev.blame_precision(b, v(spark, sf, "SELECT l_orderkey AS case, l_suppkey % 50 AS class FROM lineitem"))


@plan(f"WITH c AS ({quoted(_CONF)}) SELECT category, CASE WHEN tp + fp < 10 THEN 'note' WHEN tp / CAST(tp + fp AS DOUBLE) >= 0.4 THEN 'error' WHEN tp / CAST(tp + fp AS DOUBLE) >= 0.1 THEN 'warn' ELSE 'note' END AS severity FROM c")
def e6_calibration(spark, sf):
    c = ev.confusion(*v(spark, sf, PRED, TRUE))
    return c.select("category", ev.calibrated(F.col("precision"), F.col("tp") + F.col("fp")).alias("severity"))


@plan(f"WITH c AS ({quoted(_CONF)}), r AS (SELECT {_PR} FROM c) SELECT round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall FROM r")
def e7_macro(spark, sf):
    return ev.macro(ev.confusion(*v(spark, sf, PRED, TRUE))).select(F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@plan("SELECT o_orderpriority AS family, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed, count(*) FILTER (WHERE o_orderstatus = 'O') AS failed, round(count(*) FILTER (WHERE o_orderstatus = 'F') / CAST(count(*) AS DOUBLE), 9) AS pass_rate FROM orders GROUP BY 1")
def e8_matrix(spark, sf):
    runs = v(spark, sf, "SELECT o_orderpriority AS family, CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'fail' ELSE 'skip' END AS status FROM orders")
    return ev.matrix(runs).withColumn("pass_rate", F.round("pass_rate", 9))


@plan("SELECT event_id AS fact_id, value * 2 AS doubled FROM events WHERE event_type = 'click' AND value > 50")
def u1_table_function(spark, sf):
    from factloom.plans.relational import events

    q.external("double", lambda df: df.withColumn("doubled", F.col("value") * 2))
    spec = q.QuerySpec(scan="click", filters=[("value", ">", 50)], call_external="double", project=["fact_id", "doubled"])
    return spec.compile(lambda k: events(spark, sf).where(F.col("kind") == k))
