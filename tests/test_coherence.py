"""Contradictions, requirements and identities on literal facts."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import coherence as co
from factloom.operators import trust

COLUMNS = (
    "fact_id long, kind string, subject string, class string, mod_id string, target string, target_class string, package string, active boolean, loader string, loader_source string,"
    " event_id string, identity_certainty string, active_for_instance boolean, activation_applicable boolean, scope string, capabilities string, coverage string,"
    " member string, descriptor string, path string, dep string, locator string, line long, inner string"
)
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def facts(spark, *rows):
    made = [tuple({"fact_id": i, "kind": k, "subject": s, "locator": "l", **more}.get(n) for n in NAMES) for i, k, s, more in rows]
    return spark.createDataFrame(made, COLUMNS)


def findings(spark, *rows):
    full = [(i, "r", c, a, "error", 0.9, ["t"], "default", "observation", "asserted") for i, c, a in rows]
    return spark.createDataFrame(full, "finding_id string, rule_id string, conclusion string, affects array<string>, severity string, confidence double, tags array<string>, visibility string, proof_kind string, disposition string")


def cites(spark, *rows):
    return spark.createDataFrame(rows, "finding_id string, position int, fact_id long")


def held(x, e, f):
    found = co.contradictions(x, e, f)
    rows = {r.finding_id: r for r in co.reconciled(x, found, f).collect()}
    return rows, {(r.finding_id, r.fact_id) for r in co.against(found, f).collect()}


def frame(i, event, cls, mod=None):
    return (i, "stack_frame", event, {"class": cls, "mod_id": mod})


def test_a_class_that_ran_is_not_absent(spark):
    f = facts(spark, (1, "ref", "x", {"target": "a/b/Gone.class"}), (2, "ref", "x", {"target_class": "a/b/Here.class"}), frame(10, "e1", "a.b.Here"), frame(11, "e2", " a/b/Here"), frame(12, "e2", "a.b.Other"))
    x = findings(spark, ("p", "class-absent", ["m"]), ("q", "class-absent", ["m"]), ("r", "generic", ["m"]))
    rows, against = held(x, cites(spark, ("p", 1, 1), ("p", 2, 2), ("q", 1, 1), ("r", 1, 2)), f)
    p = rows["p"]
    assert (p.severity, p.confidence, p.visibility, p.disposition, p.tags, p.via, p.key, p.n_against) == ("note", 0.2, "explain-only", "abstained", ["t", "runtime-contradicted"], "class", "a.b.Here", 2)
    assert rows["q"].severity == "error" and rows["r"].via is None and against == {("p", 10), ("p", 11)}


def test_mods_of_one_event_use_each_other_else_a_call_shows_it(spark):
    f = facts(
        spark, frame(1, "e1", "a.A", "from"), frame(2, "e1", "b.B", "to"), frame(3, "e1", "c.C", "third"), frame(4, "e9", "b.B", "to"), frame(5, "e0", "a.A", "from"), frame(6, "e0", "z.Z", ""),
        (7, "package_owner", "lib", {"package": "com.lib"}), (8, "bytecode_call_edge", "from", {"target_class": "com/lib/deep/X"}), (9, "bytecode_call_edge", "from", {"target_class": "com/library/X"}),
    )
    x = findings(spark, ("p", "dependency-unused", ["from", "to"]), ("q", "dependency-unused", ["from", "lib"]), ("r", "dependency-unused", ["to", "nobody"]), ("s", "dependency-unused", ["from"]))
    rows, against = held(x, cites(spark), f)
    assert (rows["p"].via, rows["p"].key, rows["p"].severity, rows["p"].n_against) == ("event", "e1", "info", 5)
    assert (rows["q"].via, rows["q"].n_against) == ("call", 1) and rows["r"].via is None and rows["s"].via is None
    assert against == {("p", i) for i in (1, 2, 3, 4, 5)} | {("q", 8)}


def test_an_active_provider_is_not_missing(spark):
    f = facts(spark, (1, "mod", "lib", {"active": True}), (2, "mod", "off", {"active": False}))
    x = findings(spark, ("p", "missing-dependency", ["m", "lib"]), ("q", "missing-dependency", ["m", "off"]), ("r", "missing-dependency", ["lib"]))
    rows, against = held(x, cites(spark), f)
    assert rows["p"].via == "provider" and rows["q"].via is None and rows["r"].via is None and against == {("p", 1)}


@pytest.mark.parametrize(
    "sources,want",
    [
        ([("fabric", "runtime-log"), ("forge", "filesystem-heuristic")], "p:superseded:fabric:runtime-log"), ([("fabric", "runtime-log"), ("forge", "runtime-log")], "p"),
        ([("quilt", None), ("forge", "filesystem-heuristic")], "p:superseded:quilt:environment-evidence"), ([("forge", "pack-manifest"), ("forge", "launcher-manifest")], "p:superseded:forge:pack-manifest"),
    ],
)
def test_the_strongest_environment_supersedes(spark, sources, want):
    f = facts(spark, (100, "environment", "env", {"loader": None}), *[(i, "environment", "env", {"loader": a, "loader_source": b}) for i, (a, b) in enumerate(sources)])
    rows, _ = held(findings(spark, ("p", "loader-mismatch", ["m"])), cites(spark, ("p", 1, 1), ("p", 2, 0)), f)
    assert list(rows) == [want]


def test_the_cited_environment_may_be_the_strongest(spark):
    f = facts(spark, (1, "environment", "env", {"loader": "fabric", "loader_source": "runtime-log"}))
    rows, against = held(findings(spark, ("p", "loader-mismatch", ["m"])), cites(spark, ("p", 1, 1)), f)
    assert rows["p"].via is None and not against


COVER = [(r, "complete") for r in {*co.REGIONS.values(), "minecraft-classpath"}]
KINDS = [
    ("terminal-runtime", (1, "crash_anchor", "e", {}), (1, "log_signal", "s", {"event_id": "nowhere"})),
    ("active-descriptor", (1, "mod", "m", {"identity_certainty": "confirmed"}), (1, "mod", "m", {"identity_certainty": "confirmed", "active_for_instance": False})),
    ("known-bridge-semantics", (1, "compatibility_bridge", "b", {"scope": "api-surface", "capabilities": "api"}), (1, "compatibility_bridge", "b", {"capabilities": "api, classloading", "coverage": "complete"})),
    ("applicable-mixin", (1, "mixin", "m", {"activation_applicable": True}), (1, "mixin", "m", {})),
    ("known-runtime-mutators", (1, "mod", "m", {}), (1, "runtime_script_modifies_recipe", "r", {})),
]


@pytest.mark.parametrize("kind,good,bad", KINDS)
def test_each_kind_of_requirement(spark, kind, good, bad):
    x, e = findings(spark, ("p", "generic", [])), cites(spark, ("p", 1, 1))
    asks = spark.createDataFrame([("p", kind)], "finding_id string, requirement string")
    cover = spark.createDataFrame(COVER, "region string, state string")
    ok = co.assessed(x, asks, e, facts(spark, good), cover).first()
    no = co.assessed(x, asks, e, facts(spark, bad), cover).first()
    assert (ok.severity, ok.certainty, ok.disposition, ok.blockers, ok.why_not_error) == ("error", "confirmed", "asserted", "", False)
    assert (no.severity, no.confidence, no.certainty, no.disposition, no.blockers, no.why_not_error) == ("warn", 0.65, "undecidable", "abstained", f"{co.CODES[kind]}@{kind}", True)


def test_signals_of_an_anchored_event_are_terminal_and_regions_count(spark):
    f = facts(spark, (1, "log_signal", "s", {"event_id": "e"}), (2, "crash_anchor", "e", {}), (3, "ref", "r", {"target": "net.minecraft.World"}))
    x, e = findings(spark, ("p", "generic", [])), cites(spark, ("p", 1, 1), ("p", 2, 3))
    asks = spark.createDataFrame([("p", "terminal-runtime"), ("p", "complete-classpath"), ("p", "mappings-unknown")], "finding_id string, requirement string")
    some = spark.createDataFrame([("mod-classpath", "complete"), ("logs", "partial")], "region string, state string")
    met = {r.requirement: (r.region, r.state, r.satisfied) for r in co.requirements_met(x, asks, e, f, some, False).collect()}
    assert met["terminal-runtime"] == ("logs", "partial", True) and met["complete-classpath"] == ("minecraft-classpath", "unavailable", False)
    assert co.assessed(x, asks, e, f, some).first().certainty == "unavailable"


def test_fatal_needs_a_terminal_runtime_and_strong_findings_a_contract(spark):
    f = facts(spark, (1, "crash_anchor", "e", {}), (2, "scan_truncated", "s", {}))
    x = findings(spark, ("a", "generic", []), ("b", "generic", []), ("c", "generic", []), ("d", "generic", [])).withColumn("severity", F.lit("fatal"))
    x = x.withColumn("proof_kind", F.when(F.col("finding_id") == "c", None).otherwise("observation"))
    e = cites(spark, ("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("d", 1, 2), ("d", 2, 1))
    asks = spark.createDataFrame([("a", "terminal-runtime"), ("b", "local-artifact"), ("d", "terminal-runtime")], "finding_id string, requirement string")
    rows = {r.finding_id: r for r in co.assessed(x, asks, e, f, spark.createDataFrame(COVER, "region string, state string")).collect()}
    assert (rows["a"].severity, rows["a"].disposition) == ("fatal", "asserted") and (rows["b"].severity, rows["b"].disposition, rows["b"].why_not_error) == ("error", "downgraded", False)
    assert rows["c"].severity == "warn" and rows["c"].blockers == "strong-conclusion-certainty-below-confirmed@local-artifact,strong-conclusion-has-no-coverage-contract@local-artifact,strong-conclusion-has-no-proof-kind@local-artifact"
    assert rows["d"].blockers == "collector-reported-incomplete@local-artifact" and rows["d"].severity == "warn"


def test_a_partial_target_meets_no_requirement_of_the_whole(spark):
    x, e = findings(spark, ("p", "generic", [])), cites(spark)
    asks = spark.createDataFrame([("p", "complete-pack"), ("p", "local-artifact")], "finding_id string, requirement string")
    cover = spark.createDataFrame(COVER, "region string, state string")
    assert co.assessed(x, asks, e, facts(spark), cover, True).first().blockers == "incremental-input-is-partial@complete-pack"
    assert co.assessed(x, asks, e, facts(spark), cover, False).first().blockers == ""


def test_identities_say_what_is_meant(spark):
    f = facts(spark, (1, "ref", "s", {"target": "T", "line": 1}), (2, "ref", "s", {"target": "T", "line": 2}), (3, "ref", "s", {"target": "U", "line": 1}), (4, "ref", "s", {"class": "no matter", "target": "T", "line": 1}))
    x = findings(spark, *[(n, "class-absent", ["m"]) for n in "abcd"], ("g", "generic", ["m"]), ("h", "generic", ["m"]))
    x = x.withColumn("rule_id", F.when(F.col("finding_id") == "h", "other").otherwise("r"))
    e = cites(spark, ("a", 1, 1), ("b", 1, 2), ("c", 1, 3), ("d", 1, 4), ("g", 1, 1), ("h", 1, 1))
    none = spark.createDataFrame([], "component string, instance string")
    sums = spark.createDataFrame([("f1", "aa"), ("f2", "bb")], "subject string, hex string")
    run = lambda i, c: {r.finding_id: r for r in co.identities(x, e, f, i, c).collect()}
    one = run(none, sums)
    assert one["a"].semantic_id == one["b"].semantic_id == one["d"].semantic_id != one["c"].semantic_id
    assert one["a"].occurrence_id == one["d"].occurrence_id != one["b"].occurrence_id
    assert one["g"].semantic_id != one["h"].semantic_id and one["a"].semantic_id.startswith("finding:classabsent:")
    moved = run(none, sums.where("subject = 'f1'"))
    assert moved["a"].semantic_id == one["a"].semantic_id and moved["a"].occurrence_id != one["a"].occurrence_id
    known = run(spark.createDataFrame([("m", "m@1"), ("m", "m@2")], none.schema), sums)
    assert known["a"].semantic_id != one["a"].semantic_id
    assert run(none, sums.limit(0))["a"].semantic_id == one["a"].semantic_id


def test_set_digest_has_no_order_and_sees_every_change(spark):
    rows = spark.range(5000).selectExpr("id % 2 as g", "cast(id % 1700 as string) as line")
    digest = lambda df: {r.g: r.digest for r in trust.set_digest(df, ["g"], F.col("line")).collect()}
    one = digest(rows)
    assert one == digest(rows.repartition(7)) and len(set(one.values())) == 2
    tampered = digest(rows.withColumn("line", F.when((F.col("line") == "12") & (F.col("g") == 0), "13").otherwise(F.col("line"))))
    assert tampered[0] != one[0] and tampered[1] == one[1]
    assert digest(rows.unionByName(rows.limit(1)))[0] != one[0]
    assert digest(rows.limit(0)) == {}
