"""Stack traces to event, anchor, throwable and frame rows: the cases that the rules name, row by row."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import logs as lg
from factloom.operators import runtime as rt

MANY = "[12:00:00] [Render thread/ERROR]: net.minecraft.ReportedException: charTyped event handler\n\tat com.simibubi.create.AllKeys.isKeyDown(AllKeys.java:42)\nCaused by: java.lang.IllegalStateException: Encountered GL error off-thread\n\tat com.example.cdg.EntityFilterItem.appendHoverText(EntityFilterItem.java:77)"
ONE = MANY.replace("\n\t", " ").replace("\n", " ")


def log(spark, **texts):
    rows = [(s, i, line) for s, text in texts.items() for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "source string, line_no long, text string").repartition(3)


def described(spark, **texts):
    return rt.described(rt.events(log(spark, **texts)))


def test_a_flattened_trace_gives_the_rows_of_one_in_many_lines(spark):
    rows = {r.source: r for r in described(spark, a=MANY, b=ONE).collect()}
    a, b = rows["a"], rows["b"]
    assert a.chain == b.chain and a.semantic_fingerprint == b.semantic_fingerprint and a.fuzzy_fingerprint == b.fuzzy_fingerprint
    assert [(n.type, n.message, n.cause, n.deepest) for n in a.chain] == [
        ("net.minecraft.ReportedException", "charTyped event handler", 1, False), ("java.lang.IllegalStateException", "Encountered GL error off-thread", -1, True),
    ]
    assert [(f["class"], f.method, f.file, f.line) for n in a.chain for f in n.frames] == [
        ("com.simibubi.create.AllKeys", "isKeyDown", "AllKeys.java", 42), ("com.example.cdg.EntityFilterItem", "appendHoverText", "EntityFilterItem.java", 77),
    ]
    assert a.occurrence_id != b.occurrence_id


def test_a_trailing_suppressed_is_never_the_deepest(spark):
    text = "[1] [main/FATAL]: a.b.OuterException: x\n\tat a.B.c(B.java:1)\nCaused by: a.b.RootError: y\n\tSuppressed: a.b.SideException: z\n\t\tat a.D.e(D.java:2)"
    nodes = sorted(rt.throwable_nodes(described(spark, a=text)).collect(), key=lambda r: r["index"])
    assert [(n.type, n.cause, n.deepest, n.suppressed) for n in nodes] == [("a.b.OuterException", 1, False, False), ("a.b.RootError", -1, True, False), ("a.b.SideException", -1, False, True)]
    anchor = rt.crash_anchors(described(spark, a=text)).first()
    assert (anchor.anchor_type, anchor.root_cause_exception) == ("process-fatal", "a.b.RootError")


def test_events_below_warn_without_a_trace_give_no_rows(spark):
    rows = described(spark, a="[1] [main/INFO]: Create 6.0.10 initializing!\n[2] [main/INFO]: a.b.SomeError: said\n[3] [main/WARN]: careful")
    assert rows.count() == 3
    assert sorted((r.level, r.crash_relevance) for r in rt.runtime_events(rows).collect()) == [("INFO", "unknown"), ("WARN", "background")]
    assert rt.crash_anchors(rows).count() == 0


def test_fuzzy_fingerprints_forget_wrappers_lines_and_numbers(spark):
    one = "[12:00:00] [main/FATAL]: net.minecraft.ReportedException: wrapper 10\n\tat wrapper.Host.run(Host.java:10)\nCaused by: java.lang.IllegalStateException: GLFW error 65539\n\tat example.Mod.tick(Mod.java:20)"
    two = "[12:00:01] [main/FATAL]: java.lang.RuntimeException: rebuilt wrapper 99\n\tat other.Wrapper.call(Wrapper.java:500)\nCaused by: java.lang.IllegalStateException: GLFW error 12345\n\tat example.Mod.tick(Mod.java:900)"
    a, b = described(spark, a=one, b=two).collect()
    assert a.fuzzy_fingerprint == b.fuzzy_fingerprint and a.semantic_fingerprint != b.semantic_fingerprint


def test_field_boundaries_count(spark):
    a, b = described(spark, a="[1] [main/ERROR] [ab]: c", b="[1] [main/ERROR] [a]: bc").collect()
    assert a.semantic_fingerprint != b.semantic_fingerprint


def test_repeats_are_two_occurrences_of_one_meaning(spark):
    line = "[12:00:00] [main/ERROR]: java.lang.IllegalStateException: boom"
    a, b = described(spark, a=f"{line}\n{line}").collect()
    assert a.semantic_fingerprint == b.semantic_fingerprint and a.occurrence_id != b.occurrence_id


def test_frames_with_modules_archives_and_constructors(spark):
    text = "[1] [main/ERROR]: a.BError: x\n\tat TRANSFORMER/create@6.0/com.far.C.run(C.java:3) ~[create.jar!/:6.0]\n\tat java.base/java.util.List.get(List.java)\n\tat com.far.C.<init>(C.java:1)\n\tat com.known.deep.X.go(Native Method)"
    owners = spark.createDataFrame([("com.known", "k"), ("com.known.deep", "d"), ("com.known.deep", "e"), ("x", "create")], "package string, owner string")
    got = sorted(rt.stack_frames(described(spark, a=text), owners).collect(), key=lambda r: r.frame_index)
    assert [(r["class"], r.method, r.module, r.source_line, r.classification, r.mod_id, r.ownership) for r in got] == [
        ("com.far.C", "run", "create", 3, "mod-or-library", "create", "exclusive"), ("java.util.List", "get", "", -1, "jdk", "", "unresolved"),
        ("com.far.C.<init>(C.java:1)", "", "", -1, "mod-or-library", "", "unresolved"), ("com.known.deep.X", "go", "", -1, "mod-or-library", "", "ambiguous"),
    ]


def test_whether_a_log_recovers_is_told_by_its_last_event(spark):
    failed = "[1] [main/ERROR]: a.BException: x\n"
    ends = {"a": "[2] [main/INFO]: Done (1s)!", "b": "[2] [main/INFO]: Preparing crash report", "c": "[2] [main/INFO]: tick"}
    rows = described(spark, **{k: failed + v for k, v in ends.items()}).where("level = 'ERROR'").collect()
    assert {r.source: r.terminality for r in rows} == {"a": "recovered", "b": "crash-report-root", "c": "unknown"}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_ranges_of_lines_give_the_events_of_one_scan(spark, size):
    kinds = ["[1] [m/ERROR]: x", "[1] [m/INFO]: y", "a.BException: q", "\tat a.b.C.d(E.java:1)", "Caused by: a.b.DError", "", "plain", "   indented", "a.ZError at a.b.C.d(E.java:1) Caused by: a.YError"]
    lines = spark.range(900).selectExpr("concat('s', id % 3) as source", "id as line_no", f"element_at(array({', '.join(repr(k) for k in kinds)}), cast(pmod(xxhash64(id), {len(kinds)}) as int) + 1) as text")
    got = sorted(map(tuple, rt.numbered(lines, size).collect()))
    assert got == sorted(map(tuple, rt.numbered(lines, 1 << 20).collect())) and len({r[5] for r in got}) > 50
    plain = lambda n: sorted(map(str, lg.assembled(lines, n).collect()))
    assert plain(size) == plain(1 << 20)
    as_of = lambda n: sorted(map(str, lg.nearest_before(lines, ["line_no"], F.when(F.col("text") == "plain", F.col("line_no")), "at", n).collect()))
    assert as_of(size) == as_of(1 << 20)


def test_no_log_is_one_window(spark):
    """All windows over lines are within ranges; over a whole log only rows of ranges are scanned."""
    lines = spark.range(10).selectExpr("'s' as source", "id as line_no", "'x' as text")
    plan = rt.numbered(lines)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    assert windows and all("_range#" in x.split("], [source#")[-1] or "_handed" in x or "blank" in x or "waiting" in x for x in windows)


def test_incident_goes_from_the_stack_s_caller_to_its_callee(spark):
    text = "[0] [main/WARN]: before\n[1] [main/FATAL]: java.lang.IllegalStateException: x\n\tat com.api.Keys.isDown(Keys.java:1)\n\tat java.util.List.get(List.java:2)\n\tat com.addon.Tooltip.append(Tooltip.java:3)\n[2] [main/WARN]: after"
    owners = spark.createDataFrame([("com.api", "api"), ("com.addon", "addon")], "package string, owner string")
    rows = described(spark, a=text, b=text.replace("[0] [main/WARN]: before\n", ""))
    one = rt.incidents(rows, rt.stack_frames(rows, owners)).collect()
    assert len(one) == 1
    assert (one[0].caller, one[0].callee, one[0].ambiguous, one[0].n_occurrences, one[0].contributors) == ("com.addon.Tooltip.append", "com.api.Keys.isDown", False, 2, "addon,api")
    warned = {r.message: r.occurrence_id for r in rows.where("source = 'a' and level = 'WARN'").collect()}
    assert one[0].background_before == warned["before"] and one[0].n_background == 3 and one[0].cause == "java.lang.IllegalStateException"


def test_incident_with_shared_frames_only_is_ambiguous(spark):
    text = "[1] [main/FATAL]: a.b.XError\n\tat com.api.Keys.isDown(Keys.java:1)"
    owners = spark.createDataFrame([("com.api", "api"), ("com.api", "other")], "package string, owner string")
    rows = described(spark, a=text)
    one = rt.incidents(rows, rt.stack_frames(rows, owners)).first()
    assert (one.caller, one.callee, one.ambiguous, one.rationale) == (None, "com.api.Keys.isDown", True, "runtime frame ownership is shared by api,other")


def test_lines_are_cut_and_scanned_once_and_a_short_log_is_one_range(spark):
    """Numbers far apart make no ranges of a line each; what follows reads the stored rows."""
    lines = spark.range(40).selectExpr("'s' as source", "id * 1000000 as line_no", "if(id % 4 = 0, '[1] [m/ERROR]: x', '\\tat a.b.C.d(E.java:1)') as text")
    rows = rt.numbered(lines)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Relation [") == 2
    assert len({r._range for r in spark.read.parquet(rows.inputFiles()[0].rsplit("/", 1)[0]).collect()}) == 1
    assert max(r.event for r in rows.collect()) == 10
