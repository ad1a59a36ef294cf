"""Caveats, visibility, salient evidence, pair counts and traces on literal rows."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import findings as fi
from factloom.operators import overlap as o
from factloom.operators import query as q
from factloom.operators import resources as r
from factloom.operators import rules as ru

FACTS = "kind string, subject string, layer string, complete boolean"
RECIPE = "data/create/recipes/crushing/tuff.json"


def static(spark, *rows):
    full = [(i, "resource", family, "static-resource-state", sev, 0.9, [path], ["x"], "why") for i, family, sev, path in rows]
    return spark.createDataFrame(full, "finding_id string, category string, family string, conclusion string, severity string, confidence double, affects array<string>, tags array<string>, explanation string")


@pytest.mark.parametrize(
    "facts,label,severity",
    [
        ([], "unavailable", "error"), ([("script_discovery_coverage", "s", None, True)], "no-mutator-evidence", "error"), ([("script_discovery_coverage", "s", None, False)], "coverage-partial", "warn"),
        ([("scan_truncated", "s", "code", None)], "unavailable", "error"), ([("scan_truncated", "s", "script", None)], "coverage-partial", "warn"), ([("mixin_runtime_resource_mutation", "m", None, None)], "mutator-present", "warn"),
        ([("runtime_removed_recipe", "create:crushing/tuff", None, None)], "exact-target-modified", "note"), ([("runtime_removed_recipe", "create", None, None)], "exact-target-modified", "note"),
        ([("runtime_removed_recipe", "create:crushing/other", None, None)], "mutator-present", "warn"), ([("runtime_removed_loot_table", "create:crushing/tuff", None, None)], "mutator-present", "warn"),
    ],
)
def test_what_scripts_change_is_no_final_state(spark, facts, label, severity):
    one = fi.caveated(static(spark, ("p", "recipe-output-override", "error", RECIPE)), spark.createDataFrame(facts, FACTS)).first()
    assert (one.runtime_coverage, one.severity, one.disposition) == (label, severity, "asserted" if severity == "error" else "downgraded")
    exact = label == "exact-target-modified"
    assert (one.confidence, one.tags, one.explanation) == ((min(0.9 * 0.7, 0.7), ["x", "runtime-script-caveat"], "why" + fi.SCRIPTED) if exact else (0.9, ["x"], "why"))


def test_caveats_are_said_once_and_of_their_family(spark):
    scripts = spark.createDataFrame([("runtime_removed_recipe", "create", None, None)], FACTS)
    rows = static(spark, ("p", "recipe-output-override", "note", RECIPE), ("q", "loot-table-output-override", "note", RECIPE), ("r", "recipe-type-override", "info", "pack.mcmeta"))
    once = fi.caveated(rows, scripts)
    twice = {x.finding_id: x for x in fi.caveated(once.drop("runtime_coverage", "disposition"), scripts).collect()}
    assert twice["p"].explanation == "why" + fi.SCRIPTED and twice["p"].tags == ["x", "runtime-script-caveat"]
    assert twice["q"].runtime_coverage == "mutator-present" and twice["r"].severity == "info"


def test_visibility_goes_by_tags_and_else_stays(spark):
    rows = [("a", ["safe-crdt-merge"], "note", "default"), ("b", ["safe-merge"], "warn", "default"), ("c", ["root-metadata"], "note", "x"), ("d", ["mixin-detail"], "info", "default"), ("e", ["mixin-detail"], "warn", "default"), ("f", ["mixin"], "note", "verbose")]
    out = fi.visible(spark.createDataFrame(rows, "finding_id string, tags array<string>, severity string, visibility string"))
    assert sorted((x.finding_id, x.visibility, x.severity) for x in out.collect()) == [
        ("a", "explain-only", "info"), ("b", "explain-only", "warn"), ("c", "overlay-only", "info"), ("d", "verbose", "info"), ("e", "default", "warn"), ("f", "verbose", "note"),
    ]


def test_salient_evidence_falls_back(spark):
    rows = [(1, "k", "s", None, "a, b ,", None, "c"), (2, "k", "s", None, None, "z", None), (3, "k", "s", "p", None, None, None), (4, "k", "", None, "", "z", None)]
    facts = spark.createDataFrame(rows, "fact_id long, kind string, subject string, path string, writers string, archives string, class string").withColumn("reason", F.lit("r"))
    e = spark.createDataFrame([("f", i) for i in range(1, 5)], "finding_id string, fact_id long")
    got = {x.fact_id: x for x in fi.evidence_summary(e, facts).collect()}
    assert [got[i].writers for i in range(1, 5)] == [["a", "b"], ["z"], ["s"], []] and [got[i].path for i in range(1, 5)] == ["s", "s", "p", None]
    assert got[1].reason == "r" and got[1].diff_kind is None


@pytest.mark.parametrize(
    "path,want",
    [
        ("pack.mcmeta", "pack-mcmeta"), ("data/c/tags/items/x.json", "tag"), ("data/minecraft/advancements/recipes/redstone/dispenser.json", "advancement"), ("data/minecraft/recipe/orange_dye.json", "recipe"),
        ("data/create/recipes/crushing/tuff.json", "recipe"), ("data/mymod/custom/recipes/x.json", "generic-json"), ("assets/c/lang/en_us.lang", "lang"), ("assets/c/x.lang", "properties"), ("data/c/functions/x.mcfunction", "mcfunction"),
        ("data/c/structures/x.nbt", "structure"), ("assets/c/structures/x.nbt", "binary-asset"), ("assets/c/textures/x.png", "binary-asset"), ("assets/c/models/item/x.json", "model"), ("assets/c/atlases/b.json", "atlas"), ("data/c/models/x.json", "generic-json"),
    ],
)
def test_semantic_domains_go_by_registry_folder(spark, path, want):
    assert spark.createDataFrame([(path,)], "path string").select(r.semantic_domain(F.col("path")).alias("d")).first().d == want


def test_pair_counts_are_the_pairs(spark):
    rows = spark.range(400).selectExpr("id", "concat('t', id % 3) as target", "concat('m', hash(id) % 5) as mod", "if(id % 17 = 0, null, id % 4) as priority", "id % 3 as descriptor")
    for differ in ([], ["priority"], ["priority", "descriptor"]):
        want = {x.target: x.n for x in o.pairs(rows, ["target"], differ).groupBy("target").agg(F.count("*").alias("n")).collect()}
        got = {x.target: x.n_pairs for x in o.pair_counts(o.pair_classes(rows, ["target"], differ), ["target"], differ).collect()}
        assert got == want
    hot = spark.range(1_000_000).selectExpr("id", "'t' as target", "concat('m', id % 3) as mod")
    one = o.pair_counts(o.pair_classes(hot, ["target"]), ["target"]).first()
    assert (one.n_sites, one.n_classes) == (1_000_000, 3) and one.n_pairs == sum(a * b for a, b in ((333334, 333333), (333334, 333333), (333333, 333333)))


def test_graded_matches_meet_in_one_join(spark):
    left = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, None, 1)], "l long, x string, y long")
    right = spark.createDataFrame([(10, "a", 1), (11, "a", 2), (12, None, 1)], "r long, x string, y long")
    out = q.graded_match(left, right, [("both", [("x", "x"), ("y", "y")]), ("x", [("x", "x")])], "l", "r")
    assert sorted(map(tuple, out.collect())) == [(1, 10, "both"), (1, 11, "x"), (2, 10, "x"), (2, 11, "x")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_trace_is_counted_by_the_run(spark):
    facts = spark.createDataFrame([(1, "coremod", "a"), (2, "coremod", "b"), (3, "unknown_source", "c"), (4, "mod", "d")], "fact_id long, kind string, subject string").withColumn("name", F.lit("n")).withColumn("file", F.lit("f"))
    rules = [x for x in ru.CORE if x.id in ("forge-coremod-present", "unknown-source", "duplicate-id")]
    found, told = ru.traced_pack(rules, facts)
    assert found.count() == 3
    assert sorted(told()) == [("duplicate-id", 1, 0), ("forge-coremod-present", 2, 2), ("unknown-source", 1, 1)]


def test_counts_of_a_pack_are_those_of_its_findings(spark):
    columns = "fact_id long, kind string, subject string, related string, type string, archive string, file string, trust_score long"
    rows = [(1, "mod_relationship", "a", "b", "known_incompatible", "x", "x", 1), (2, "mod", "b", None, None, None, "y", 1), (3, "mod", "b", None, None, None, "x", 1), (4, "mod", "b", None, None, None, "y", None)]
    rows += [(5, "sbom", "s", None, None, None, None, 10), (6, "sbom", None, None, None, None, None, 10), (7, "sbom", "s", None, None, None, None, 60), (8, "uses_unsafe", "u", None, None, "s", None, 1), (9, "uses_unsafe", "u", None, None, "s", None, 1)]
    facts = spark.createDataFrame(rows, columns)
    rules = [x for x in ru.CORE if x.id in ("known-incompatible-mods", "sbom-security-correlation", "duplicate-id")]
    want = sorted((r.id, facts.where(F.col("kind").isin(*r.inputs)).count(), ru.evaluate(r, facts).count()) for r in rules)
    assert want == [("duplicate-id", 3, 1), ("known-incompatible-mods", 4, 2), ("sbom-security-correlation", 5, 1)]
    assert sorted(map(tuple, ru.counted_pack(rules, facts).collect())) == want
    assert sorted(map(tuple, ru.counted_pack(rules, facts.limit(0)).collect())) == [(r, 0, 0) for r, _, _ in want]


def test_pairs_of_a_hot_key_are_counted_and_not_listed(spark):
    """40,000 facts on each side of one key: a list of their pairs would have 1,600,000,000 rows."""
    n = 40_000
    facts = spark.range(2 * n).selectExpr(
        "id as fact_id", f"if(id < {n}, 'mod_relationship', 'mod') as kind", f"if(id < {n}, 'a', 'b') as subject", "'b' as related", "'known_incompatible' as type", "'x' as archive", "'y' as file")
    rule = next(x for x in ru.CORE if x.id == "known-incompatible-mods")
    assert list(map(tuple, ru.counted_pack([rule], facts).collect())) == [(rule.id, 2 * n, n * n)]


def test_incompatible_mods_are_both_affected(spark):
    rows = [(1, "mod_relationship", "a", "b", "known_incompatible", "x.jar", "x.jar"), (2, "mod", "b", None, None, None, "y.jar")]
    facts = spark.createDataFrame(rows, "fact_id long, kind string, subject string, related string, type string, archive string, file string")
    one = ru.evaluate(next(x for x in ru.CORE if x.id == "known-incompatible-mods"), facts).first()
    assert (one.affects, one.tags, one.visibility) == (["a", "b"], ["incompatible", "relationship"], "default")
