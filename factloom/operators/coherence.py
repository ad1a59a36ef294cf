"""Findings held against facts of other layers: what contradicts a conclusion, and which of its
requirements are met.

Contradictions are kept as the one key that says it all (a class that ran, an event in which both
mods ran, an edge, a provider, an environment) with the number of facts behind it, which come from
counts by key; the facts themselves are joined on demand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import checkpointed
from factloom.operators.runtime import field, hexed, joined
from factloom.operators.trust import set_digest

#: How much an environment's loader is worth by where it was read, 40 for any other.
SOURCE_WORTH = {
    "explicit-pack-manifest": 100, "pack-manifest": 100, "modrinth-manifest": 100, "curseforge-manifest": 100,
    "instance-manifest": 90, "launcher-manifest": 90, "instance-metadata": 90, "runtime-log": 80, "artifact-consensus": 50, "filesystem-heuristic": 10,
}
#: The region of coverage that each requirement asks about.
REGIONS = {
    "local-artifact": "materialized-artifacts", "complete-pack": "materialized-artifacts", "complete-provider-universe": "materialized-artifacts",
    "complete-classpath": "mod-classpath", "runtime-evidence": "logs", "terminal-runtime": "logs", "runtime-profile": "runtime-profile",
    "authoritative-loader": "loader-identity", "active-descriptor": "materialized-artifacts", "known-bridge-semantics": "loader-classpath",
    "compatible-mappings": "mappings", "applicable-mixin": "mod-classpath", "complete-resource-blobs": "resource-blobs", "relevant-resources": "datapacks",
    "complete-vanilla-baseline": "vanilla-resources", "known-runtime-mutators": "runtime-mutators",
}
#: What an unmet requirement is called, and which ones a partial target can't meet.
CODES = {
    "terminal-runtime": "runtime-terminality-unconfirmed", "active-descriptor": "active-descriptor-unconfirmed", "known-bridge-semantics": "bridge-compatibility-undecidable",
    "applicable-mixin": "mixin-activation-unconfirmed", "known-runtime-mutators": "runtime-mutator-coverage-unknown",
}
WHOLE_TARGET = ("complete-pack", "complete-provider-universe", "relevant-resources")
MUTATORS = ("mixin_runtime_resource_mutation", "runtime_script_modifies_recipe")


def class_name(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.trim(c), r"(\.class)+$", ""), F.lit("/"), F.lit("."))


def strongest_environment(facts: DataFrame) -> DataFrame:
    """(fact_id, loader, loader_source) of the first fact of the best source, or nothing if the facts
    of that source disagree."""
    worth = F.lit(40)
    for source, value in SOURCE_WORTH.items():
        worth = F.when(F.col("loader_source") == source, value).otherwise(worth)
    known = facts.where("kind = 'environment' and loader is not null").withColumn("worth", worth)
    by = known.groupBy("worth").agg(F.countDistinct("loader").alias("n"), F.min(F.struct("fact_id", "loader", "loader_source")).alias("e"))
    return by.orderBy(F.desc("worth")).limit(1).where("n = 1").select("e.*")


def _frames(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'stack_frame'")


def _absent(findings: DataFrame, evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """By class: the first cited target that a stack frame shows to exist."""
    ran = _frames(facts).where("class is not null").groupBy(class_name(F.col("class")).alias("key")).agg(F.count(F.lit(1)).alias("n_against"))
    targets = facts.select("fact_id", class_name(F.coalesce("target", "target_class")).alias("key")).where("key is not null")
    cited = findings.where("conclusion in ('class-absent', 'method-absent')").select("finding_id").join(evidence, "finding_id")
    met = cited.join(targets, "fact_id").join(ran, "key")
    return met.groupBy("finding_id").agg(F.min_by(F.struct("key", "n_against"), "position").alias("k")).select("finding_id", F.lit("class").alias("via"), "k.key", "k.n_against")


def _together(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b, key): the first event whose stack has frames of both. An event's mods are a small set,
    that of one stack, so a mod that runs everywhere is no hot key."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("mod_id")).distinct()
    ran = _frames(facts).where("mod_id <> ''").join(asked, "mod_id", "left_semi").groupBy("subject").agg(F.collect_set("mod_id").alias("mods"))
    both = ran.select("subject", F.explode("mods").alias("a"), "mods").select("subject", "a", F.explode("mods").alias("b"))
    return both.join(pairs, ["a", "b"]).groupBy("a", "b").agg(F.min("subject").alias("key"))


def _called(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b, fact_id): edges of a's code to a class in a package of b."""
    owned = facts.where("kind = 'package_owner'").select(F.col("package").alias("prefix"), F.col("subject").alias("b")).distinct()
    names = F.split(F.replace("target_class", F.lit("/"), F.lit(".")), r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.array_join(F.slice(names, 1, n), "."))
    edges = facts.where("kind = 'bytecode_call_edge' and target_class is not null").select(F.col("subject").alias("a"), "fact_id", "target_class")
    edges = edges.join(pairs.select("a").distinct(), "a", "left_semi").select("a", "fact_id", F.explode(every).alias("prefix"))
    return edges.join(owned, "prefix").join(pairs, ["a", "b"]).select("a", "b", "fact_id").distinct()


def _unused(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """By event, else by edge: what shows the first component to use the second."""
    asked = findings.where("conclusion = 'dependency-unused' and size(affects) >= 2").select("finding_id", F.col("affects")[0].alias("a"), F.col("affects")[1].alias("b"))
    pairs = asked.select("a", "b").distinct()
    events = _together(pairs, facts)
    of_mod = _frames(facts).where("mod_id <> ''").groupBy("mod_id").agg(F.count(F.lit(1)).alias("n"))
    chosen = events.select(F.col("key").alias("subject")).distinct()
    weight = _frames(facts).where("mod_id <> ''").select("subject", "mod_id").distinct().join(chosen, "subject", "left_semi").join(of_mod, "mod_id")
    weight = weight.groupBy(F.col("subject").alias("key")).agg(F.sum("n").alias("n_against"))
    ran = events.join(weight, "key").select("a", "b", F.lit("event").alias("via"), "key", "n_against")
    calls = _called(pairs.join(events.select("a", "b"), ["a", "b"], "left_anti"), facts)
    calls = calls.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_against")).select("a", "b", F.lit("call").alias("via"), F.concat_ws(">", "a", "b").alias("key"), "n_against")
    return asked.join(ran.unionByName(calls), ["a", "b"]).select("finding_id", "via", "key", "n_against")


def _missing(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """By provider: an active mod that is what is missed."""
    active = facts.where("kind = 'mod' and active").groupBy(F.col("subject").alias("key")).agg(F.count(F.lit(1)).alias("n_against"))
    asked = findings.where("conclusion = 'missing-dependency' and size(affects) >= 2").select("finding_id", F.col("affects")[1].alias("key"))
    return asked.join(active, "key").select("finding_id", F.lit("provider").alias("via"), "key", "n_against")


def _loader(findings: DataFrame, evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """By environment: the strongest one is not the first that is cited."""
    cited = findings.where("conclusion = 'loader-mismatch'").select("finding_id").join(evidence, "finding_id")
    cited = cited.join(facts.where("kind = 'environment'").select("fact_id"), "fact_id").groupBy("finding_id").agg(F.min_by("fact_id", "position").alias("cited"))
    best = F.broadcast(strongest_environment(facts).select(F.col("fact_id").alias("best")))  # one row
    return cited.crossJoin(best).where("cited <> best").select("finding_id", F.lit("environment").alias("via"), F.col("best").cast("string").alias("key"), F.lit(1).cast("long").alias("n_against"))


def contradictions(findings: DataFrame, evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """(finding_id, via, key, n_against): at most one for each finding. findings: (finding_id,
    conclusion, affects array); evidence: (finding_id, position, fact_id); facts: (fact_id, kind,
    subject, class, mod_id, target, target_class, package, active, loader, loader_source)."""
    out = _absent(findings, evidence, facts).unionByName(_unused(findings, facts))
    return out.unionByName(_missing(findings, facts)).unionByName(_loader(findings, evidence, facts))


def against(found: DataFrame, facts: DataFrame) -> DataFrame:
    """(finding_id, fact_id): all facts behind contradictions."""
    by = lambda via: found.where(F.col("via") == via).select("finding_id", "key")
    frames = _frames(facts)
    classes = by("class").join(frames.select("fact_id", class_name(F.col("class")).alias("key")), "key")
    mods = frames.where("mod_id <> ''").select(F.col("subject").alias("key"), "mod_id").distinct()
    events = by("event").join(mods, "key").join(frames.select("fact_id", "mod_id"), "mod_id")
    pairs = by("call").select("finding_id", F.split("key", ">")[0].alias("a"), F.split("key", ">")[1].alias("b"))
    calls = pairs.join(_called(pairs.select("a", "b").distinct(), facts), ["a", "b"])
    mods = by("provider").join(facts.where("kind = 'mod' and active").select(F.col("subject").alias("key"), "fact_id"), "key")
    best = by("environment").select("finding_id", F.col("key").cast("long").alias("fact_id"))
    out = best
    for df in (classes, events, calls, mods):
        out = out.unionByName(df.select("finding_id", "fact_id"))
    return out.distinct()


def against_counts(found: DataFrame, facts: DataFrame) -> DataFrame:
    """(finding_id, n, first, last): how many facts are behind each contradiction, and the first and
    last of them, counted once for each key and not for each finding. A fact has one class and mod."""
    own = F.col("fact_id")
    counts = [F.countDistinct(own).alias("n"), F.min(own).alias("first"), F.max(own).alias("last")]
    frames = _frames(facts).where("fact_id is not null")
    asked = checkpointed(found.select("finding_id", "via", "key").distinct())
    keys = lambda via: asked.where(F.col("via") == via).select("key").distinct()
    classes = frames.select("fact_id", class_name(F.col("class")).alias("key")).join(keys("class"), "key", "left_semi").groupBy("key").agg(*counts)
    named = frames.where("mod_id <> ''")
    of_mod = named.groupBy("mod_id").agg(*counts)
    ran = named.select(F.col("subject").alias("key"), "mod_id").distinct().join(keys("event"), "key", "left_semi").join(of_mod, "mod_id")
    events = ran.groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    pairs = keys("call").select("key", F.split("key", ">")[0].alias("a"), F.split("key", ">")[1].alias("b"))
    calls = pairs.join(_called(pairs.select("a", "b").distinct(), facts), ["a", "b"]).groupBy("key").agg(*counts)
    active = facts.where("kind = 'mod' and active and fact_id is not null").select(F.col("subject").alias("key"), "fact_id")
    mods = active.join(keys("provider"), "key", "left_semi").groupBy("key").agg(*counts)
    best = keys("environment").withColumn("fact_id", F.col("key").cast("long")).groupBy("key").agg(*counts)
    known = None
    for via, df in (("class", classes), ("event", events), ("call", calls), ("provider", mods), ("environment", best)):
        one = df.select(F.lit(via).alias("via"), "key", "n", "first", "last")
        known = one if known is None else known.unionByName(one)
    return asked.join(known, ["via", "key"]).groupBy("finding_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def reconciled(findings: DataFrame, found: DataFrame, facts: DataFrame) -> DataFrame:
    """findings with contradicted ones kept for explanation only: a note, or info if a dependency was
    called unused; confidence at most 0.2; abstained and undecidable; tagged. A mismatched loader's
    id says what it gave way to. findings: also (severity, confidence, tags, visibility)."""
    rows = findings.join(found.select("finding_id", "via", "key", "n_against"), "finding_id", "left")
    best = F.broadcast(strongest_environment(facts).select(F.col("fact_id").cast("string").alias("key"), "loader", "loader_source"))
    rows = rows.join(best, "key", "left")
    hit = F.col("via").isNotNull()
    to = F.when(F.col("conclusion") == "dependency-unused", "info").otherwise("note")
    suffix = F.concat_ws(":", F.lit(":superseded"), "loader", F.coalesce("loader_source", F.lit("environment-evidence")))
    tag = F.array_union("tags", F.array(F.lit("runtime-contradicted")))
    return rows.select(
        F.when(F.col("via") == "environment", F.concat("finding_id", suffix)).otherwise(F.col("finding_id")).alias("finding_id"), "conclusion", "affects",
        F.when(hit, to).otherwise(F.col("severity")).alias("severity"), F.col("severity").alias("proposed"),
        F.when(hit, F.least("confidence", F.lit(0.2))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(hit, "explain-only").otherwise(F.col("visibility")).alias("visibility"), F.when(hit, "abstained").otherwise("asserted").alias("disposition"),
        F.when(hit, tag).otherwise(F.col("tags")).alias("tags"), "via", "key", F.coalesce("n_against", F.lit(0)).alias("n_against"),
    )


def _flags(evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """What each finding's cited facts say for its requirements, read once."""
    anchors = facts.where("kind = 'crash_anchor'").select(F.col("subject").alias("event_id")).distinct().withColumn("_ended", F.lit(True))
    target = F.replace(F.coalesce("target", "target_class"), F.lit("."), F.lit("/"))
    cited = evidence.select("finding_id", "fact_id").distinct().join(facts.select("fact_id", "kind", "event_id", "identity_certainty", "active_for_instance", "activation_applicable", target.alias("_target")), "fact_id")
    # only signals of an event can have ended with it; the rest would all meet under a null event
    asks = (F.col("kind") == "log_signal") & F.col("event_id").isNotNull()
    rows = cited.where(asks).join(anchors, "event_id", "left").unionByName(cited.where(~F.coalesce(asks, F.lit(False))).withColumn("_ended", F.lit(False)))
    said = rows.select(
        "finding_id", (F.col("kind") == "scan_truncated").alias("truncated"),
        ((F.col("kind") == "crash_anchor") | ((F.col("kind") == "log_signal") & F.coalesce("_ended", F.lit(False)))).alias("terminal"),
        (F.coalesce(F.col("identity_certainty") == "undecidable", F.lit(False)) | F.coalesce(~F.col("active_for_instance"), F.lit(False))).alias("undecidable"),
        (F.coalesce(F.col("identity_certainty") == "confirmed", F.lit(False)) | F.coalesce("active_for_instance", F.lit(False))).alias("active_here"),
        F.coalesce("activation_applicable", F.lit(False)).alias("applicable"),
        F.coalesce(F.startswith("_target", F.lit("net/minecraft/")) | F.startswith("_target", F.lit("com/mojang/")), F.lit(False)).alias("of_game"),
    )
    flags = ("truncated", "terminal", "undecidable", "active_here", "applicable", "of_game")
    return said.groupBy("finding_id").agg(*[F.max(c).alias(c) for c in flags])


def _whole(facts: DataFrame) -> DataFrame:
    """One row: whether a bridge leaves loading open, and whether anything changes resources as it runs."""
    able = F.transform(F.split(F.coalesce("capabilities", F.lit("")), ","), lambda c: F.trim(c))
    loads = F.coalesce(F.col("scope") == "mod-runtime", F.lit(False)) | F.arrays_overlap(able, F.array(*map(F.lit, ("metadata", "classloading", "runtime"))))
    known = F.coalesce(F.col("coverage") == "complete", F.lit(False)) & F.array_contains(able, "runtime")
    open_ = (F.col("kind") == "compatibility_bridge") & loads & ~known
    return facts.agg(F.coalesce(F.max(open_), F.lit(False)).alias("bridged"), F.coalesce(F.max(F.col("kind").isin(*MUTATORS)), F.lit(False)).alias("mutated"))


def requirements_met(findings: DataFrame, requirements: DataFrame, evidence: DataFrame, facts: DataFrame, coverage: DataFrame, incremental: bool) -> DataFrame:
    """(finding_id, requirement, region, state, satisfied, code): one row for each requirement of
    each finding, judged by one predicate for its kind. coverage: (region, state), at most one row
    for each of the few regions; a region without one is unavailable."""
    rows = requirements.select("finding_id", "requirement").distinct().join(_flags(evidence, facts), "finding_id", "left")
    region, code = F.lit("materialized-artifacts"), F.lit("required-coverage-incomplete")
    for name, r in REGIONS.items():
        region = F.when(F.col("requirement") == name, r).otherwise(region)
    for name, c in CODES.items():
        code = F.when(F.col("requirement") == name, c).otherwise(code)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    region = F.when((F.col("requirement") == "complete-classpath") & flag("of_game"), "minecraft-classpath").otherwise(region)
    rows = rows.withColumn("region", region).join(F.broadcast(coverage.select("region", "state")), "region", "left").crossJoin(F.broadcast(_whole(facts)))
    rows = rows.withColumn("state", F.coalesce("state", F.lit("unavailable")))
    whole, asks = F.col("state") == "complete", F.col("requirement")
    met = (
        F.when(asks == "terminal-runtime", flag("terminal")).when(asks == "active-descriptor", whole & flag("active_here") & ~flag("undecidable"))
        .when(asks == "known-bridge-semantics", whole & ~F.col("bridged")).when(asks == "applicable-mixin", whole & flag("applicable"))
        .when(asks == "known-runtime-mutators", whole & ~F.col("mutated")).otherwise(whole)
    )
    partial = F.lit(incremental) & asks.isin(*WHOLE_TARGET)
    return rows.select(
        "finding_id", "requirement", "region", "state", F.when(partial, False).otherwise(met).alias("satisfied"),
        F.when(partial, "incremental-input-is-partial").otherwise(code).alias("code"),
    )


def assessed(findings: DataFrame, requirements: DataFrame, evidence: DataFrame, facts: DataFrame, coverage: DataFrame, incremental: bool = False) -> DataFrame:
    """(finding_id, severity, confidence, certainty, disposition, blockers, why_not_error) from
    findings of (finding_id, severity, confidence, proof_kind, disposition). Blockers are unmet
    requirements and cut inputs, and, of errors and worse, no proof kind, no requirement, or a
    certainty below confirmed. With blockers a finding abstains, is undecidable, or unavailable where
    a region is, and an error becomes a warning of confidence at most 0.65. Fatal is for terminal
    run-time evidence only, and otherwise an error, downgraded."""
    met = requirements_met(findings, requirements, evidence, facts, coverage, incremental)
    by = met.groupBy("finding_id").agg(
        F.collect_set(F.when(~F.col("satisfied"), F.concat_ws("@", "code", "requirement"))).alias("_unmet"), F.count(F.lit(1)).alias("_n"),
        F.max(F.col("state") == "unavailable").alias("_unavailable"), F.max(F.col("requirement") == "terminal-runtime").alias("_ends"),
    )
    cut = _flags(evidence, facts).select("finding_id", "truncated")
    rows = findings.join(by, "finding_id", "left").join(cut, "finding_id", "left")
    proof, sure = F.coalesce("proof_kind", F.lit("heuristic")), F.col("confidence")
    derived = proof.isin("observation", "deterministic-derivation")
    tier = F.when(derived & (sure >= 0.9), "confirmed").when(derived & (sure >= 0.7), "probable").when((proof == "heuristic") & (sure >= 0.7), "possible").otherwise("undecidable")
    rows = rows.withColumn("_tier", tier)
    strong = F.col("severity").isin("error", "fatal")
    here = lambda c, name: F.when(c, F.lit(f"{name}@local-artifact"))
    more = F.array_compact(F.array(
        here(F.coalesce("truncated", F.lit(False)), "collector-reported-incomplete"), here(strong & F.col("proof_kind").isNull(), "strong-conclusion-has-no-proof-kind"),
        here(strong & (F.coalesce("_n", F.lit(0)) == 0), "strong-conclusion-has-no-coverage-contract"), here(strong & (F.col("_tier") != "confirmed"), "strong-conclusion-certainty-below-confirmed"),
    ))
    rows = rows.withColumn("_blockers", F.array_sort(F.concat(F.coalesce("_unmet", F.array().cast("array<string>")), more)))
    blocked = F.size("_blockers") > 0
    lowered = (F.col("severity") == "fatal") & ~F.coalesce("_ends", F.lit(False))
    down = lowered | F.coalesce(F.col("disposition") == "downgraded", F.lit(False))
    now = F.when(lowered, "error").otherwise(F.col("severity"))
    return rows.select(
        "finding_id", F.when(blocked & strong, "warn").otherwise(now).alias("severity"), F.when(blocked & strong, F.least(sure, F.lit(0.65))).otherwise(sure).alias("confidence"),
        F.when(blocked, F.when(F.coalesce("_unavailable", F.lit(False)), "unavailable").otherwise("undecidable")).otherwise(F.col("_tier")).alias("certainty"),
        F.when(down, "downgraded").when(blocked, "abstained").otherwise("asserted").alias("disposition"), F.array_join("_blockers", ",").alias("blockers"), blocked.alias("why_not_error"),
    )


def blockers_by_kind(met: DataFrame) -> DataFrame:
    """How often each kind of requirement was met and not: (requirement, n_satisfied, n_blocked)."""
    return met.groupBy("requirement").agg(F.count_if("satisfied").alias("n_satisfied"), F.count_if(~F.col("satisfied")).alias("n_blocked"))


#: Attributes of a cited fact that tell one conclusion from another.
TELLING = ("target", "target_class", "member", "descriptor", "path", "dep")


def input_identity(checksums: DataFrame) -> DataFrame:
    """One row, (digest): what was analysed, from (subject, hex) of every file, in any order."""
    rows = checksums.where("subject is not null and hex is not null")
    one = set_digest(rows.withColumn("_all", F.lit(1)), ["_all"], F.concat(field("locator", F.col("subject")), field("sha256", F.col("hex"))))
    empty = rows.sparkSession.range(1).select(F.lit("").alias("_none"))
    return empty.join(one, how="left").select(F.coalesce("digest", "_none").alias("digest"))


def identities(findings: DataFrame, evidence: DataFrame, facts: DataFrame, instances: DataFrame, checksums: DataFrame) -> DataFrame:
    """(finding_id, semantic_id, occurrence_id). The semantic id says what is concluded: the kind, for
    generic findings their rule; the components, as the instances known of each or by name; and, but
    for generic findings of named components, what their evidence is about and its telling attributes.
    The occurrence id adds the input and where the evidence stands. findings: (finding_id, rule_id,
    conclusion, affects); facts: (fact_id, kind, subject, TELLING, locator, line, inner); instances:
    (component, instance)."""
    generic = F.col("conclusion") == "generic"
    rows = findings.select("finding_id", "rule_id", "conclusion", F.coalesce("affects", F.array().cast("array<string>")).alias("affects"))
    parts = rows.select("finding_id", F.explode(F.array_distinct("affects")).alias("component")).join(instances.select("component", "instance").distinct(), "component", "left")
    entity = F.when(F.col("instance").isNull(), F.struct(F.lit("component").alias("tag"), F.col("component").alias("v"))).otherwise(F.struct(F.lit("entity").alias("tag"), F.col("instance").alias("v")))
    entities = parts.groupBy("finding_id").agg(F.array_sort(F.collect_set(entity)).alias("_entities"))
    cited = evidence.select("finding_id", "fact_id").distinct().join(facts, "fact_id")
    blank = F.lit("")
    said = F.array(F.struct(blank.alias("key"), blank.alias("value")), *[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in TELLING])
    about = F.flatten(F.collect_set(F.transform(F.filter(said, lambda x: x["value"].isNotNull()), lambda x: F.struct(F.col("kind"), F.col("subject"), x["key"].alias("key"), x["value"].alias("value")))))
    place = F.struct("locator", F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("inner", blank).alias("inner"))
    by = cited.groupBy("finding_id").agg(F.array_sort(F.array_distinct(about)).alias("_about"), F.array_sort(F.collect_set(place)).alias("_places"))
    rows = rows.join(entities, "finding_id", "left").join(by, "finding_id", "left")
    fact = lambda x: F.concat(hexed("fact-kind", x["kind"]), hexed("fact-subject", x["subject"]), F.when(x["key"] != "", hexed(x["key"], x["value"])).otherwise(blank))
    semantic = F.concat(
        hexed("kind", F.col("conclusion")), F.when(generic, hexed("condition-family", F.col("rule_id"))).otherwise(blank),
        F.coalesce(joined(F.transform("_entities", lambda x: hexed(x["tag"], x["v"]))), blank),
        F.when(~generic | (F.size("affects") == 0), F.coalesce(joined(F.transform("_about", fact)), blank)).otherwise(blank),
    )
    rows = rows.withColumn("semantic_id", F.concat_ws(":", F.lit("finding"), F.replace("conclusion", F.lit("-"), F.lit("")), F.substring(F.sha2(F.unhex(semantic), 256), 1, 24)))
    rows = rows.crossJoin(F.broadcast(input_identity(checksums)))  # one row
    stands = lambda x: F.concat(hexed("source", x["locator"]), hexed("line", x["line"]), hexed("inner", x["inner"]))
    occurrence = F.concat(hexed("semantic", F.col("semantic_id")), hexed("input", F.col("digest")), F.coalesce(joined(F.transform("_places", stands)), blank))
    return rows.select("finding_id", "semantic_id", F.concat(F.lit("finding-occurrence:"), F.sha2(F.unhex(occurrence), 256)).alias("occurrence_id"))
