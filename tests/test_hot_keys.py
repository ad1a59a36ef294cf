"""Keys of many rows: what a hot key costs, and that the rows stay right."""

import re
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from factloom.operators import coherence as co
from factloom.operators import deps as d
from factloom.operators import overlap as o
from factloom.operators import perf as p
from factloom.operators import resources as r
from factloom.operators.graph import checkpointed
from factloom.operators.query import dealt_join, graded_match


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("few", [1000, 0])
def test_a_hot_key_is_joined_in_blocks(spark, few):
    left = spark.createDataFrame([(i % 7 and "hot", i) for i in range(60)] + [(None, 99), ("cold", 1)], "k string, a int")
    right = spark.createDataFrame([(i % 5 and "hot", i) for i in range(40)] + [(None, 98), ("cold", 2), ("other", 3)], "k string, b int")
    want = Counter((x.k, x.a, y.b) for x in left.collect() for y in right.collect() if x.k is not None and x.k == y.k)
    assert Counter(map(tuple, dealt_join(left, right, ["k"], few, 8).select("k", "a", "b").collect())) == want


def test_a_version_is_judged_once_for_all_providers(spark, monkeypatch):
    judged = []
    judge = d.with_in_range
    monkeypatch.setattr(d, "with_in_range", lambda df, *a: (judged.append(df.count()), judge(df, *a))[1])
    declared = spark.createDataFrame([(f"m{i}", "alias", ">=1.2.0" if i % 2 else None, "semver", "requires", True) for i in range(40)], "id string, dep string, range string, dialect string, relation string, mandatory boolean")
    providers = spark.createDataFrame([("alias", f"p{i}", ("1.0.0", "2.0.0", None)[i % 3]) for i in range(30)], "id string, provider string, version string")
    rows = d.version_findings(declared, providers).collect()
    assert judged == [6]  # two ranges, three versions
    assert Counter((r.kind, r.version, r.via_alias) for r in rows) == Counter({("wrong-version", "1.0.0", True): 200})
    bumps = spark.createDataFrame([("alias", "1.0.0", "2.0.0")], "dep string, old string, new string")
    assert Counter(r.effect for r in d.update_impact(declared, bumps).collect()) == Counter({"fixed": 20, "same": 20}) and judged[1:] == [2, 2]


@pytest.mark.parametrize("many", ["providers", "asked"])
def test_undisclosed_asks_from_the_smaller_side(spark, monkeypatch, many):
    stored = []
    keep = d.checkpointed
    monkeypatch.setattr(d, "checkpointed", lambda df: (stored.append(df.count()), keep(df))[1])
    n = 300
    providers = [("alias", f"p{i}") for i in range(n)] + [(f"p{i}", f"p{i}") for i in range(n)] + [("lone", "lone")]
    declared = [(f"m{i}", "alias") for i in range(n)] + ([("m1", f"x{i}") for i in range(n)] if many == "asked" else []) + [("m2", "p3")]
    implicit = [("m1", "p7"), ("m1", "lone"), ("m2", "alias"), ("m400", "p7"), ("m400", "absent"), ("m2", "p3")]
    out = d.undisclosed(*(spark.createDataFrame(x, "id string, dep string") for x in (implicit, declared)), spark.createDataFrame(providers, "id string, provider string"))
    assert sorted(map(tuple, out.collect())) == [("m1", "lone"), ("m400", "p7")]
    assert sum(stored) < 5 * n


def test_contradicting_facts_are_counted_by_key(spark):
    frames = [(i, "stack_frame", f"ev{i % 3}", f"a.B{i % 2}", ("x", "y", "")[i % 3 if i % 7 else 0]) for i in range(60)]
    cols = "fact_id long, kind string, subject string, class string, mod_id string"
    facts = spark.createDataFrame([*frames, (90, "mod", "z", None, None), (91, "bytecode_call_edge", "x", None, None), (92, "package_owner", "q", None, None)], cols)
    facts = facts.withColumn("active", F.lit(True)).withColumn("target_class", F.expr("if(fact_id = 91, 'c/q/K', null)")).withColumn("package", F.expr("if(fact_id = 92, 'c.q', null)"))
    found = spark.createDataFrame([("1", "class", "a.B1"), ("2", "event", "ev0"), ("3", "event", "ev1"), ("4", "call", "x>q"), ("5", "provider", "z"), ("6", "environment", "77"), ("7", "class", "a.B1")], "finding_id string, via string, key string")
    out = co.against_counts(found, facts)
    want = co.against(found, facts).groupBy("finding_id").agg(F.count("*").alias("n"), F.min("fact_id").alias("first"), F.max("fact_id").alias("last"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and out.count() == 7


def test_facts_without_an_event_never_meet(spark):
    facts = spark.range(8).selectExpr("id as fact_id", "case id when 0 then 'crash_anchor' when 1 then 'log_signal' when 2 then 'log_signal' when 3 then 'log_signal' when 4 then null else 'stack_frame' end as kind", "if(id = 0, 'ev', 's') as subject",
        "case id when 1 then 'ev' when 2 then 'no' when 5 then 'ev' end as event_id", "string(null) as target", "string(null) as target_class", "string(null) as identity_certainty", "boolean(null) as active_for_instance", "true as activation_applicable")
    facts = checkpointed(facts)
    flags = co._flags(spark.range(8).selectExpr("string(id) as finding_id", "id as fact_id"), facts)
    assert {x.finding_id for x in flags.where("terminal").collect()} == {"0", "1"} and flags.where("applicable").count() == 8
    assert "isnotnull(event_id" in plan_of(flags)


def test_pairs_of_equal_ids_are_all_kept(spark):
    hot = spark.createDataFrame([(1, "a.T", "m", 9.0), (2, "b.T", "m", 9.0), (3, "a.T", "m", 1.0)], "id long, class string, method string, percent double")
    sites = spark.createDataFrame([(5, "a.T", "m", "replace"), (5, "a.T", "n", "wrap"), (6, None, "m", "replace")], "id long, class string, method string, operation string")
    assert sorted(map(tuple, p.hot_methods_patched(hot, sites).collect())) == [(1, 5, "class", "note"), (1, 5, "method", "warn"), (2, 5, "simple", "note"), (2, 5, "simple", "note")]


def test_graded_pairs_are_not_grouped(spark):
    left = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 1)], "l long, x string, y long")
    right = spark.createDataFrame([(10, "a", 2), (10, "b", 3), (10, "a", 1)], "r long, x string, y long")
    out = graded_match(left, right, [("both", [("x", "x"), ("y", "y")]), ("x", [("x", "x")])], "l", "r")
    assert list(map(tuple, out.collect())) == [(1, 10, "both")]
    assert "Aggregate" not in plan_of(out).split("Join ")[0]


def test_values_are_compared_and_not_counted(spark):
    rows = spark.createDataFrame([("p", "w1", "f", "1"), ("p", "w2", "f", "2"), ("q", "w1", None, "1"), ("q", "w2", "g", "1")], "path string, writer string, flag string, value string")
    entries = rows.withColumnRenamed("flag", "key")
    assert "Expand" not in plan_of(r.key_relation(entries))
    assert sorted(map(tuple, r.key_relation(entries).collect())) == [("p", "conflicting", 1), ("q", "disjoint", 0)]
    union = r.key_union(entries.withColumn("object", F.expr("path = 'p'")), "conflict")
    assert "min(value" not in plan_of(union)  # read from stored keys
    assert sorted((x.path, x["class"], x.conflicts) for x in union.collect()) == [("p", "conflict", "f"), ("q", "json-merge-candidate", None)]


def test_pairs_check_a_group_once(spark):
    rows = spark.range(40).selectExpr("id", "id % 3 as target", "id % 5 as mod", "id % 2 as priority")
    out = o.pairs(rows, ["target"], ["priority"])
    assert plan_of(out).count("LeftSemi") == 2  # once for each side
    classes = o.pair_classes(rows, ["target"], ["priority"])
    assert "id % 5" not in plan_of(o.pair_counts(classes, ["target"], ["priority"]))


@pytest.mark.parametrize("few", [1000, 0])
def test_graded_pairs_match_brute_force_and_cost_no_sets(spark, monkeypatch, few):
    monkeypatch.setattr(dealt_join, "__defaults__", (few, 8))
    row = lambda i, m: (i * 7 % m, (None, "p", "q", "pp")[i * i % 11 % 4], i * 5 % 13 % 3, (None, 1, 2)[i * 3 % 17 % 3])
    left, right = [row(i, 25) for i in range(60)], [row(i, 20) for i in range(50)]
    on, best = {"a": (1, 2), "b": (1,), "c": (3,)}, {}
    for x, y in product(left, right):
        best.setdefault((x[0], y[0]), set()).update(n for n, cols in on.items() if all(x[k] is not None and x[k] == y[k] for k in cols))
    tables = [spark.createDataFrame(rows, f"{n} long, x string, y long, z long") for rows, n in ((left, "l"), (right, "r"))]
    out = graded_match(*tables, [("a", [("x", "x"), ("y", "y")]), ("b", [("x", "x")]), ("c", [("z", "z")])], "l", "r")
    assert sorted(map(tuple, out.collect())) == sorted((a, b, min(q)) for (a, b), q in best.items() if q)
    assert "inline(" in plan_of(out) and "array_intersect" not in plan_of(out)


def _declared_and_providers(spark):
    declared = spark.createDataFrame([(f"m{i}", ("alias", "p1", "absent")[i % 3], ">=1.2.0" if i % 2 else None, "semver", ("requires", "breaks", "discourages", "other")[i // 2 % 4], i % 5 > 0) for i in range(120)],
        "id string, dep string, range string, dialect string, relation string, mandatory boolean")
    providers = spark.createDataFrame([("alias", f"p{i}", ("1.0.0", "2.0.0", None)[i % 3]) for i in range(30)] + [("p1", "p1", "1.0.0")], "id string, provider string, version string")
    return declared, providers


def test_rows_without_a_finding_go_before_duplicates_are_sought(spark):
    declared, providers = _declared_and_providers(spark)
    twice = declared.unionByName(declared).distinct()
    every = sorted(map(str, d.version_findings(declared, providers).collect()))
    out = d.version_findings(twice, providers)
    assert sorted(map(str, out.collect())) == every
    assert "Aggregate" in plan_of(out).split("Join LeftSemi")[0]  # below declared's distinct
    some = d.version_findings(twice, providers, d.KINDS[1:])
    assert sorted(map(str, some.collect())) == [x for x in every if "kind='wrong" not in x] and len(every) > some.count() > 0


def test_a_pair_carries_its_provider_alone(spark):
    declared, providers = _declared_and_providers(spark)
    out = d.met_versions(declared, providers)
    assert re.search(r"Generate inline\(.*\[provider#\d+, via_alias#\d+\]", plan_of(out))
    want = Counter((x.id, y.id, y.version) for x in declared.collect() for y in providers.collect() if x.dep == y.id)
    assert Counter((x.id, x.dep, x.version) for x in out.collect()) == want


def test_findings_by_alias_ask_of_aliases_only(spark, monkeypatch):
    declared, providers = _declared_and_providers(spark)
    every = sorted(map(str, d.version_findings(declared, providers).collect()))
    kept, keep = [], d.checkpointed
    monkeypatch.setattr(d, "checkpointed", lambda df: (kept.append(back := keep(df)), back)[1])
    for by_alias in (True, False):
        out = sorted(map(str, d.version_findings(declared, providers, via_alias=by_alias).collect()))
        assert out and out == [x for x in every if f"via_alias={by_alias}" in x]
        assert {x._dep for x in kept[-1].collect()} == {"alias" if by_alias else "p1"}
