"""Collisions of documents that several writers ship under one path."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators.graph import checkpointed
from factloom.operators.query import bounded_samples


def _several(column: str) -> Column:
    """Whether a group has two values or more: counting different ones would copy its rows for each
    column counted."""
    return F.coalesce(F.min(column) < F.max(column), F.lit(False))


def collisions(writes: DataFrame) -> DataFrame:
    """writes: (path, writer, content). Paths of two writes or more, their writers, and whether
    all contents are equal."""
    out = writes.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_writes"), F.array_join(F.sort_array(F.collect_set("writer")), ",").alias("writers"),
        (F.countDistinct(F.sha2("content", 256)) == 1).alias("identical"),
    )
    return out.where("n_writes >= 2")


#: Asset domains below data/ and assets/, by a folder of the path.
DATA_DOMAINS = (("recipe", ("/recipe/", "/recipes/")), ("loot-table", ("/loot_table/", "/loot_tables/")), ("advancement", ("/advancement/", "/advancements/")))
ASSET_DOMAINS = (
    ("blockstate", "/blockstates/"), ("model", "/models/"), ("atlas", "/atlases/"), ("shader", "/shaders/"), ("font", "/font/"), ("particle", "/particles/"),
)
#: Documents of which one is kept, never a union.
SINGLE = ("recipe", "loot-table", "advancement", "blockstate", "model", "font")
ROOT = "pack.mcmeta"


def is_json(path: Column) -> Column:
    return path.endswith(".json") | (path == ROOT)


def domain(path: Column) -> Column:
    """What a path holds: JSON by its root and folder, other files by how telling they are."""
    data, assets = path.startswith("data/"), path.startswith("assets/")
    out = F.when(path == ROOT, "pack-mcmeta")
    binary = F.when(path.contains("/shaders/"), "shader").when(path.contains("/font/"), "font").when(path.endswith(".ogg") | path.contains("/sounds/"), "sounds").otherwise("binary-asset")
    out = out.when(~is_json(path), binary).when(data & path.contains("/tags/"), "tag").when(assets & path.contains("/lang/"), "lang")
    for name, folders in DATA_DOMAINS:
        out = out.when(data & (path.contains(folders[0]) | path.contains(folders[1])), name)
    out = out.when(assets & path.endswith("/sounds.json"), "sounds")
    for name, folder in ASSET_DOMAINS:
        out = out.when(assets & path.contains(folder), name)
    return out.otherwise("generic-json")


#: What the folder after the namespace holds, below data and below assets.
DATA_REGISTRIES = {
    "tags": "tag", "recipe": "recipe", "recipes": "recipe", "loot_table": "loot-table", "loot_tables": "loot-table", "advancement": "advancement", "advancements": "advancement",
    "predicate": "predicate", "predicates": "predicate", "item_modifier": "item-modifier", "item_modifiers": "item-modifier",
}
ASSET_REGISTRIES = {"blockstate": "blockstate", "blockstates": "blockstate", "model": "model", "models": "model", "atlas": "atlas", "atlases": "atlas"}


def semantic_domain(path: Column) -> Column:
    """What kind of document a path is, by its extension and the folder right after its namespace: an
    advancement about recipes is an advancement. The semantic diff goes by it, the collision class
    by domain()."""
    ends, registry = path.endswith, F.coalesce(F.get(F.split(path, "/"), F.lit(2)), F.lit(""))
    structure = path.startswith("data/") & (path.contains("/structures/") | path.contains("/structure/"))
    out = F.when((path == ROOT) | ends("/" + ROOT), "pack-mcmeta").when(ends(".mcfunction"), "mcfunction")
    out = out.when(path.contains("/lang/") & (ends(".json") | ends(".lang")), "lang").when(ends(".lang"), "properties")
    out = out.when(ends(".nbt") | ends(".snbt"), F.when(structure, "structure").otherwise("binary-asset")).when(~ends(".json"), "binary-asset")
    for root, names in (("data/", DATA_REGISTRIES), ("assets/", ASSET_REGISTRIES)):
        for folder, kind in names.items():
            out = out.when(path.startswith(root) & (registry == folder), kind)
    return out.otherwise("generic-json")


def key_union(entries: DataFrame, conflict: str, shown: int = 6) -> DataFrame:
    """entries: (path, writer, object boolean, key, value), one for each key, or one with a null
    key for a document that is no object. Disjoint or equal keys are safe; the first conflicting
    keys are listed."""
    per = checkpointed(entries.groupBy("path", "key").agg(F.bool_and("object").alias("_o"), _several("value").alias("_v")))
    kinds = per.groupBy("path").agg(F.bool_and("_o").alias("_o"))
    bad = bounded_samples(per.where("_v and key is not null"), ["path"], "key", shown, "conflicts").withColumnRenamed("n_values", "n_conflicts")
    cls = F.when(~F.col("_o"), "json-merge-candidate").when(F.col("n_conflicts") > 0, conflict).otherwise("safe-json-object-merge")
    return kinds.join(bad, "path", "left").select("path", cls.alias("class"), F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"), "conflicts")


def key_relation(entries: DataFrame) -> DataFrame:
    """disjoint, shared equal or shared conflicting keys for each path."""
    per = entries.groupBy("path", "key").agg(_several("writer").alias("_w"), _several("value").alias("_v"))
    n = per.groupBy("path").agg(F.count_if("_w").alias("shared"), F.count_if("_v").alias("conflicting"))
    return n.select("path", F.when(F.col("conflicting") > 0, "conflicting").when(F.col("shared") > 0, "shared-equal").otherwise("disjoint").alias("relation"), "conflicting")


def tag_class(tags: DataFrame) -> DataFrame:
    """tags: (path, valid, replace, has_required)."""
    a = tags.groupBy("path").agg(F.bool_or(~F.col("valid")).alias("i"), F.bool_or("replace").alias("r"), F.bool_or("has_required").alias("q"))
    return a.select("path", F.when(F.col("i"), "tag-invalid").when(F.col("r"), "tag-replace-order-dependent").when(F.col("q"), "tag-mixed-required").otherwise("safe-crdt-merge").alias("class"))


def merged_tags(tags: DataFrame) -> DataFrame:
    """tags: (path, position, replace, value). Values from the last replacing writer on, as a set."""
    last = F.coalesce(F.max(F.when(F.col("replace"), F.col("position"))).over(W.partitionBy("path")), F.lit(-(1 << 62)))
    kept = tags.withColumn("_l", last).withColumn("_r", F.max(F.col("replace").cast("int")).over(W.partitionBy("path")) > 0).where("position >= _l")
    return kept.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("values"), F.max("_r").alias("replace"))


def merged_map(entries: DataFrame) -> DataFrame:
    """The union of keys, the last position's value for each."""
    return entries.groupBy("path", "key").agg(F.max_by("value", "position").alias("value"))


def cross_format(paths: DataFrame) -> DataFrame:
    """Names that come with two extensions or more."""
    p = paths.select(F.regexp_extract("path", r"^(.*)\.([a-z]+)$", 1).alias("base"), F.regexp_extract("path", r"^(.*)\.([a-z]+)$", 2).alias("ext"))
    return p.groupBy("base").agg(F.array_join(F.sort_array(F.collect_set("ext")), ",").alias("formats")).where(F.contains("formats", F.lit(",")))


def overlay_action(cls: Column) -> Column:
    return (
        F.when(cls == "identical", "keep-any").when(cls.isin("safe-crdt-merge", "safe-json-object-merge", "lang-json-merge", "lang-properties-merge"), "merge")
        .when(cls == "root-metadata", "generate-own").otherwise("pick-winner")
    )


def collision_class(identical: Column, dom: Column, tag: Column, union: Column, parsed: Column, path: Column) -> Column:
    """The class of a path that several write. tag: what its tag files make; union: of JSON objects,
    conflict if a key has two values, json-merge-candidate if one is no object, else safe; parsed:
    whether all writers' texts can be read. The first that holds: equal bytes, tags, languages, the
    root description, JSON by its domain, other files."""
    json = is_json(path) & parsed
    text = path.startswith("assets/") & path.contains("/lang/") & parsed
    merged = lambda conflict: F.when(union == "conflict", conflict).otherwise(union)
    return (
        F.when(identical, "identical").when(dom == "tag", tag).when(text & path.endswith(".json"), "lang-json-merge").when(text & path.endswith(".lang"), "lang-properties-merge")
        .when(path == ROOT, "root-metadata").when(json & (dom == "atlas"), "order-dependent-atlas").when(json & (dom == "shader"), "order-dependent-shader")
        .when(json & (dom == "sounds"), merged("order-dependent-sound-def")).when(json & dom.isin(*SINGLE), "json-override").when(json, merged("json-merge-candidate"))
        .when(~is_json(path), "binary-override").otherwise("unsafe-replace")
    )


def semantic_diffs(parsed: DataFrame, aspects: list[str]) -> DataFrame:
    """parsed: (path, writer, semantic_hash, aspects). Paths of two writers whose hashes differ,
    with the first aspect that does. Two values differ if one of two 64-bit hashes does: least and
    greatest numbers are kept in hash tables, and strings would be sorted or copied for each column."""
    columns = [*aspects, "semantic_hash"]
    hashed = {f"_{i}{c}": F.when(F.col(c).isNotNull(), F.xxhash64(c, F.lit(i))) for c in columns for i in (0, 1)}
    rows = parsed.select("path", "writer", *(h.alias(n) for n, h in hashed.items()))
    per = rows.groupBy("path", "writer").agg(*(f(n).alias(f"{f.__name__}{n}") for n in hashed for f in (F.min, F.max)))
    g = per.groupBy("path").agg(F.count("writer").alias("writers"), *(f(f"{f.__name__}{n}").alias(f"{f.__name__}{n}") for n in hashed for f in (F.min, F.max)))
    several = lambda c: reduce(or_, (F.coalesce(F.col(f"min_{i}{c}") < F.col(f"max_{i}{c}"), F.lit(False)) for i in (0, 1)))
    kind = F.lit("other")
    for a in reversed(aspects):
        kind = F.when(several(a), a).otherwise(kind)
    return g.where((F.col("writers") >= 2) & several("semantic_hash")).select("path", "writers", kind.alias("kind"))


def divergence(elements: DataFrame) -> DataFrame:
    """Elements that some of a path's writers have and others lack."""
    total = elements.groupBy("path").agg(F.countDistinct("writer").alias("_t"))
    per = elements.groupBy("path", "element").agg(F.countDistinct("writer").alias("n"))
    return per.join(total, "path").where("n < _t").select("path", "element", "n")


def semantic_severity(impact: Column, confidence: Column) -> Column:
    return (
        F.when(impact == "crash", "error").when(impact.isin("gameplay", "load", "visual"), F.when(confidence >= 0.85, "warn").otherwise("note"))
        .when(impact.isin("text", "cosmetic", "compat"), "note").otherwise("info")
    )


def namespace_owners(paths: DataFrame) -> DataFrame:
    ns = F.element_at(F.split("path", "/"), 1)
    return paths.groupBy(ns.alias("namespace")).agg(F.array_join(F.sort_array(F.collect_set("writer")), ",").alias("owners"))
