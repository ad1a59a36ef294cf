"""Collision queries. Paths, writers and contents come from documents, keys and values from the
numbers of line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.model import view
from factloom.operators import resources as r
from factloom.plans.base import Plans

plan = Plans()

WRITES = "SELECT lang || '/' || CAST(n_chars % 60 AS STRING) || '.json' AS path, source AS writer, text AS content FROM documents"
PATHS = """SELECT CASE l_linenumber + CASE WHEN l_quantity > 25 THEN 7 ELSE 0 END WHEN 1 THEN 'assets/a/lang/' WHEN 2 THEN 'data/a/tags/items/' WHEN 3 THEN 'data/b/recipes/' WHEN 4 THEN 'assets/b/shaders/' WHEN 5 THEN 'assets/c/textures/' WHEN 6 THEN 'assets/c/font/'
  WHEN 7 THEN 'assets/c/atlases/' WHEN 8 THEN 'data/b/loot_table/' WHEN 9 THEN 'data/b/advancements/' WHEN 10 THEN 'assets/c/blockstates/' WHEN 11 THEN 'assets/c/models/item/' WHEN 12 THEN 'assets/c/particles/' WHEN 13 THEN 'assets/e' ELSE '' END
  || CASE WHEN l_quantity > 25 AND l_linenumber = 6 THEN CAST(l_suppkey AS STRING) || '/sounds.json' WHEN l_quantity > 25 AND l_linenumber = 7 THEN 'pack.mcmeta' ELSE 'p' || CAST(l_suppkey AS STRING) || CASE l_partkey % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.png' ELSE '.lang' END END AS path,
  'w' || CAST(l_orderkey % 6 AS STRING) AS writer, l_orderkey AS position, l_returnflag AS flag, 'k' || CAST(l_quantity AS STRING) AS k0, CASE WHEN l_suppkey % 5 = 0 THEN '1' ELSE CAST(l_orderkey % 4 AS STRING) END AS value, l_quantity, l_suppkey % 11 <> 3 AS parsed FROM lineitem"""
#: One entry for each path, writer and key.
ENTRIES = f"SELECT path, writer, 'k' || CAST(CAST(l_quantity AS BIGINT) % 8 AS STRING) AS key, min(value) AS value, min(position) AS position FROM ({PATHS}) p GROUP BY 1, 2, 3"
JSON = "(path LIKE '%.json' OR path = 'pack.mcmeta')"
DOMAIN = f"""CASE WHEN path = 'pack.mcmeta' THEN 'pack-mcmeta' WHEN NOT {JSON} THEN CASE WHEN contains(path, '/shaders/') THEN 'shader' WHEN contains(path, '/font/') THEN 'font' WHEN path LIKE '%.ogg' OR contains(path, '/sounds/') THEN 'sounds' ELSE 'binary-asset' END
  WHEN starts_with(path, 'data/') THEN CASE WHEN contains(path, '/tags/') THEN 'tag' WHEN contains(path, '/recipe/') OR contains(path, '/recipes/') THEN 'recipe' WHEN contains(path, '/loot_table/') OR contains(path, '/loot_tables/') THEN 'loot-table'
    WHEN contains(path, '/advancement/') OR contains(path, '/advancements/') THEN 'advancement' ELSE 'generic-json' END
  WHEN starts_with(path, 'assets/') THEN CASE WHEN contains(path, '/lang/') THEN 'lang' WHEN path LIKE '%/sounds.json' THEN 'sounds' WHEN contains(path, '/blockstates/') THEN 'blockstate' WHEN contains(path, '/models/') THEN 'model' WHEN contains(path, '/atlases/') THEN 'atlas'
    WHEN contains(path, '/shaders/') THEN 'shader' WHEN contains(path, '/font/') THEN 'font' WHEN contains(path, '/particles/') THEN 'particle' ELSE 'generic-json' END ELSE 'generic-json' END"""


def entries(spark, sf):
    return view(spark, sf, ENTRIES)


@plan(f"SELECT path, count(*) AS n_writes, string_agg(DISTINCT writer, ',' ORDER BY writer) AS writers, count(DISTINCT content) = 1 AS identical FROM ({WRITES}) w GROUP BY path HAVING count(*) >= 2")
def c1_collisions(spark, sf):
    return r.collisions(view(spark, sf, WRITES))


@plan(f"SELECT path FROM ({WRITES}) w GROUP BY path HAVING count(*) >= 2 AND count(DISTINCT content) = 1")
def c2_identical(spark, sf):
    return r.collisions(view(spark, sf, WRITES)).where("identical").select("path")


TAGS = f"SELECT path, position, flag = 'R' AND value = '0' AS replace, flag <> 'N' OR value <> '3' AS valid, value = '2' AS has_required, value FROM ({PATHS}) p"
_TAGC = "CASE WHEN bool_or(NOT valid) THEN 'tag-invalid' WHEN bool_or(replace) THEN 'tag-replace-order-dependent' WHEN bool_or(has_required) THEN 'tag-mixed-required' ELSE 'safe-crdt-merge' END"
_UNION = f"SELECT path, count(*) FILTER (WHERE v > 1) AS n, string_agg(key, ', ' ORDER BY key) FILTER (WHERE v > 1 AND rk <= 3) AS first, count(*) FILTER (WHERE v > 1) - 3 AS more FROM (SELECT *, row_number() OVER (PARTITION BY path, v > 1 ORDER BY key) AS rk FROM (SELECT path, key, count(DISTINCT value) AS v FROM ({ENTRIES}) e GROUP BY path, key) x) y GROUP BY path"


@plan(f"""WITH d AS (SELECT path, {DOMAIN} AS domain, count(DISTINCT value) = 1 AS identical, bool_and(parsed) AS parsed FROM ({PATHS}) p GROUP BY 1, 2), t AS (SELECT path, {_TAGC} AS tag FROM ({TAGS}) x GROUP BY path), u AS ({_UNION})
  SELECT d.path, CASE WHEN identical THEN 'identical' WHEN domain = 'tag' THEN tag WHEN parsed AND starts_with(d.path, 'assets/') AND contains(d.path, '/lang/') AND d.path LIKE '%.json' THEN 'lang-json-merge'
    WHEN parsed AND starts_with(d.path, 'assets/') AND contains(d.path, '/lang/') AND d.path LIKE '%.lang' THEN 'lang-properties-merge' WHEN d.path = 'pack.mcmeta' THEN 'root-metadata' WHEN d.path NOT LIKE '%.json' THEN 'binary-override' WHEN NOT parsed THEN 'unsafe-replace'
    WHEN domain IN ('atlas', 'shader') THEN 'order-dependent-' || domain WHEN domain IN ('recipe', 'loot-table', 'advancement', 'blockstate', 'model', 'font') THEN 'json-override'
    WHEN n = 0 THEN 'safe-json-object-merge' WHEN domain = 'sounds' THEN 'order-dependent-sound-def' ELSE 'json-merge-candidate' END AS class FROM d JOIN t ON d.path = t.path JOIN u ON d.path = u.path""")
def c3_collision_class(spark, sf):
    p = view(spark, sf, PATHS)
    same = p.groupBy("path").agg((F.countDistinct("value") == 1).alias("identical"), F.bool_and("parsed").alias("parsed"))
    tags = r.tag_class(view(spark, sf, TAGS)).withColumnRenamed("class", "tag")
    union = r.key_union(entries(spark, sf).withColumn("object", F.lit(True)), "conflict").select("path", F.col("class").alias("u"))
    df = same.join(tags, "path").join(union, "path")
    cls = r.collision_class(F.col("identical"), r.domain(F.col("path")), F.col("tag"), F.col("u"), F.col("parsed"), F.col("path"))
    return df.select("path", cls.alias("class"))


@plan(f"SELECT path, CASE WHEN n > 0 THEN 'json-override' ELSE 'safe-json-object-merge' END AS class, n AS n_conflicts, CASE WHEN more > 0 THEN first || ' (+' || CAST(more AS STRING) || ' more)' ELSE first END AS conflicts FROM ({_UNION}) u")
def c4_key_union(spark, sf):
    return r.key_union(entries(spark, sf).withColumn("object", F.lit(True)), "json-override", 3)


@plan(f"""SELECT path, CASE WHEN count(*) FILTER (WHERE v > 1) > 0 THEN 'conflicting' WHEN count(*) FILTER (WHERE w > 1) > 0 THEN 'shared-equal' ELSE 'disjoint' END AS relation, count(*) FILTER (WHERE v > 1) AS conflicting
  FROM (SELECT path, key, count(DISTINCT writer) AS w, count(DISTINCT value) AS v FROM ({ENTRIES}) e GROUP BY path, key) x GROUP BY path""")
def c5_key_relation(spark, sf):
    return r.key_relation(entries(spark, sf))


@plan(f"SELECT path, {_TAGC} AS class FROM ({TAGS}) t GROUP BY path")
def c6_tag_class(spark, sf):
    return r.tag_class(view(spark, sf, TAGS))


@plan(f"""WITH t AS (SELECT *, coalesce(max(CASE WHEN replace THEN position END) OVER (PARTITION BY path), -1) AS l, bool_or(replace) OVER (PARTITION BY path) AS rr FROM ({TAGS}) t)
  SELECT path, string_agg(DISTINCT value, ',' ORDER BY value) AS values, bool_or(rr) AS replace FROM t WHERE position >= l GROUP BY path""")
def c7_tag_merge(spark, sf):
    return r.merged_tags(view(spark, sf, TAGS))


ONE = f"SELECT path, key, position, min(value) AS value FROM ({ENTRIES}) e GROUP BY path, key, position"


@plan(f"SELECT path, key, arg_max(value, position) AS value FROM ({ONE}) o GROUP BY path, key")
def c8_map_merge(spark, sf):
    return r.merged_map(view(spark, sf, ONE))


@plan(f"SELECT regexp_extract(path, '^(.*)\\.([a-z]+)$', 1) AS base, string_agg(DISTINCT regexp_extract(path, '^(.*)\\.([a-z]+)$', 2), ',' ORDER BY regexp_extract(path, '^(.*)\\.([a-z]+)$', 2)) AS formats FROM ({PATHS}) p GROUP BY 1 HAVING count(DISTINCT regexp_extract(path, '^(.*)\\.([a-z]+)$', 2)) >= 2")
def c9_cross_format(spark, sf):
    return r.cross_format(view(spark, sf, PATHS))


@plan(f"SELECT path, CASE {_TAGC} WHEN 'safe-crdt-merge' THEN 'merge' ELSE 'pick-winner' END AS action FROM ({TAGS}) t GROUP BY path")
def c10_overlay_action(spark, sf):
    return r.tag_class(view(spark, sf, TAGS)).select("path", r.overlay_action(F.col("class")).alias("action"))


@plan(f"SELECT DISTINCT path, {DOMAIN} AS domain FROM ({PATHS}) p")
def c11_domain(spark, sf):
    return view(spark, sf, PATHS).select("path", r.domain(F.col("path")).alias("domain")).distinct()


_FOLDERS = ("tags", "recipe", "recipes", "loot_tables", "advancements", "advancement", "predicate", "item_modifiers", "structures", "lang", "blockstates", "models", "atlases", "textures", "custom")
_ENDS = (".json", ".json", ".json", ".json", ".mcfunction", ".nbt", ".snbt", ".lang", ".png", "/pack.mcmeta", ".json")
DOCUMENTS = "SELECT DISTINCT CASE l_linenumber % 3 WHEN 0 THEN 'data/' WHEN 1 THEN 'assets/' ELSE 'other/' END || 'ns' || CAST(l_suppkey % 4 AS STRING) || '/' || CASE l_partkey % 15 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FOLDERS)) + " END || CASE l_orderkey % 3 WHEN 0 THEN '/recipes' WHEN 1 THEN '/structure' ELSE '' END || '/d' || CAST(l_suppkey % 9 AS STRING) || CASE l_orderkey % 11 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ENDS)) + " END AS path FROM lineitem"
_DATA, _ASSETS = ("CASE string_split(path, '/')[3] " + " ".join(f"WHEN '{f}' THEN '{k}'" for f, k in names.items()) + " ELSE 'generic-json' END" for names in (r.DATA_REGISTRIES, r.ASSET_REGISTRIES))


@plan(f"""SELECT path, CASE WHEN regexp_matches(path, '(^|/)pack\\.mcmeta$') THEN 'pack-mcmeta' WHEN path LIKE '%.mcfunction' THEN 'mcfunction' WHEN path LIKE '%/lang/%' AND regexp_matches(path, '\\.(json|lang)$') THEN 'lang' WHEN path LIKE '%.lang' THEN 'properties'
  WHEN regexp_matches(path, '\\.s?nbt$') THEN CASE WHEN regexp_matches(path, '^data/.*/structures?/') THEN 'structure' ELSE 'binary-asset' END WHEN path NOT LIKE '%.json' THEN 'binary-asset'
  WHEN starts_with(path, 'data/') THEN {_DATA} WHEN starts_with(path, 'assets/') THEN {_ASSETS} ELSE 'generic-json' END AS domain FROM ({DOCUMENTS}) p""")
def c11_semantic_domain(spark, sf):
    return view(spark, sf, DOCUMENTS).select("path", r.semantic_domain(F.col("path")).alias("domain"))


@plan(f"""SELECT path, count(DISTINCT writer) AS writers, CASE WHEN count(DISTINCT flag) > 1 THEN 'flag' WHEN count(DISTINCT value) > 1 THEN 'value' ELSE 'other' END AS kind
  FROM ({PATHS}) p GROUP BY path HAVING count(DISTINCT writer) >= 2 AND count(DISTINCT flag || value) >= 2""")
def c12_semantic_diff(spark, sf):
    df = view(spark, sf, PATHS).withColumn("semantic_hash", F.concat("flag", "value"))
    return r.semantic_diffs(df, ["flag", "value"])


@plan(f"SELECT CASE WHEN f > 1 THEN 'flag' WHEN v > 1 THEN 'value' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT path, count(DISTINCT flag) AS f, count(DISTINCT value) AS v FROM ({PATHS}) p GROUP BY path HAVING count(DISTINCT writer) >= 2 AND count(DISTINCT flag || value) >= 2) x GROUP BY 1")
def c13_diff_kind(spark, sf):
    df = view(spark, sf, PATHS).withColumn("semantic_hash", F.concat("flag", "value"))
    return r.semantic_diffs(df, ["flag", "value"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@plan(f"""WITH e AS ({ENTRIES}), t AS (SELECT path, count(DISTINCT writer) AS t FROM e GROUP BY path) SELECT e.path, e.key AS element, count(DISTINCT writer) AS n FROM e JOIN t ON e.path = t.path GROUP BY e.path, e.key, t HAVING count(DISTINCT writer) < t""")
def c14_divergence(spark, sf):
    return r.divergence(entries(spark, sf).withColumnRenamed("key", "element"))


@plan(f"SELECT path, n AS n_conflicts FROM ({_UNION}) u WHERE n > 0")
def c15_language_conflicts(spark, sf):
    return r.key_union(entries(spark, sf).withColumn("object", F.lit(True)), "conflict").where("n_conflicts > 0").select("path", "n_conflicts")


@plan(f"SELECT path, writer, CASE flag WHEN 'A' THEN 'error' WHEN 'N' THEN CASE WHEN l_quantity >= 25 THEN 'warn' ELSE 'note' END ELSE 'info' END AS severity FROM ({PATHS}) p")
def c16_semantic_severity(spark, sf):
    impact = F.when(F.col("flag") == "A", "crash").when(F.col("flag") == "N", "load").otherwise("none")
    return view(spark, sf, PATHS).select("path", "writer", r.semantic_severity(impact, F.when(F.col("l_quantity") >= 25, 0.9).otherwise(0.5)).alias("severity"))


@plan(f"SELECT split_part(path, '/', 1) AS namespace, string_agg(DISTINCT writer, ',' ORDER BY writer) AS owners FROM ({PATHS}) p GROUP BY 1")
def c17_namespace_owners(spark, sf):
    return r.namespace_owners(view(spark, sf, PATHS))
