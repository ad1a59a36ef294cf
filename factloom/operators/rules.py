"""Declarative rules: rows of facts to findings with evidence."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from factloom.model import value

#: Other names that an attribute may have, tried in order.
ALIASES = {
    "archive": ("file", "jar", "locator"),
    "path": ("subject", "resource", "file"),
    "trust_score": ("score",),
    "mod_id": ("id", "name"),
}
#: A finding's confidence where its rule gives none.
CONFIDENCE, USUAL = {"mixin": 0.7}, 0.9


#: A side of so few facts is sent to all.
FEW = 10_000


@dataclass
class Rule:
    """kind is fact, distinct, join, aggregate or correlation. where is SQL text over the fact's
    columns (join and correlation: aliases a and b). {name} in title and finding is a column;
    finding is the id of what is found, by default the rule with its facts, so that equal findings
    of several facts or runs meet. related is a kind whose facts of the finding's path say more.
    affects are templates of the components concerned, by default the fact's subject."""

    id: str
    kind: str
    inputs: tuple[str, ...]
    severity: str
    where: str = "true"
    title: str = ""
    category: str = "general"
    column: str = ""
    finding: str = ""
    related: str = ""
    least: int = 2
    keys: tuple[str, ...] = ()
    having: str = "true"
    tags: tuple[str, ...] = field(default_factory=tuple)
    version: int = 3
    affects: tuple[str, ...] = ()
    visibility: str = "default"


def attribute(df: DataFrame, name: str) -> Column:
    """A column's display string, or that of the first other name it has."""
    found = [value(df, n)[0] for n in (name, *ALIASES.get(name, ())) if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def rendered(df: DataFrame, template: str) -> Column:
    """A template with each {name} replaced by its column; what is unresolved stays as text."""
    parts = re.split(r"(\{[a-z_.:]+\})", template)
    cols = [
        F.coalesce(attribute(df, p[1:-1].removeprefix("attr:").replace(".", "_")), F.lit(p)) if re.fullmatch(r"\{.*\}", p) else F.lit(p)
        for p in parts
        if p
    ]
    return F.concat(*cols) if cols else F.lit("")


def with_settings(text: str, settings: dict) -> str:
    """Rule text with {settings.name} as SQL literals."""
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else str(x)
    return re.sub(r"\{settings\.([\w.]+)\}", lambda m: quote(settings[m[1]]), text)


def resolved(affects: Column) -> Column:
    """What a template left unresolved names no component."""
    return F.filter(affects, lambda a: a.isNotNull() & ~F.contains(a, F.lit("{")))


def default_confidence(category: Column) -> Column:
    c = F.lit(USUAL)
    for k, v in CONFIDENCE.items():
        c = F.when(category == k, v).otherwise(c)
    return c


def legacy_capped(findings: DataFrame) -> DataFrame:
    """Findings of rules below version 3: at most warn, confidence at most 0.6, tagged."""
    old = F.col("rule_version") < 3
    worse = F.col("severity").isin("error", "fatal")
    return findings.withColumns(
        {
            "severity": F.when(old & worse, "warn").otherwise(F.col("severity")),
            "confidence": F.when(old, F.least("confidence", F.lit(0.6))).otherwise(F.col("confidence")),
            "tags": F.when(old, F.array_append("tags", F.lit("legacy-rule"))).otherwise(F.col("tags")),
        }
    )


def _finding(df: DataFrame, rule: Rule, key: Column, evidence: Column, affects: Column) -> DataFrame:
    return df.select(
        (rendered(df, rule.finding) if rule.finding else F.concat(F.lit(f"{rule.id}:"), key)).alias("finding_id"),
        F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.lit(rule.category).alias("category"),
        rendered(df, rule.title or rule.id).alias("title"),
        default_confidence(F.lit(rule.category)).alias("confidence"),
        evidence.alias("evidence"), resolved(F.array(*[rendered(df, a) for a in rule.affects]) if rule.affects else affects).alias("affects"),
        F.array(*map(F.lit, rule.tags)).cast("array<string>").alias("tags"), F.lit(rule.version).alias("rule_version"), F.lit(rule.visibility).alias("visibility"),
    )


def evaluate(rule: Rule, facts: DataFrame) -> DataFrame:
    """facts: wide rows with kind, fact_id and subject."""
    own = facts.where(F.col("kind").isin(*rule.inputs))
    if rule.kind == "fact":
        df = own.where(F.expr(rule.where))
        return _finding(df, rule, F.col("fact_id").cast("string"), F.array("fact_id"), F.array("subject"))
    if rule.kind == "distinct":
        shown = attribute(own, rule.column)
        df = own.where(F.expr(rule.where)).groupBy("subject").agg(
            F.countDistinct(shown).alias("count"), F.array_join(F.sort_array(F.collect_set(shown)), ", ").alias("values"),
            F.sort_array(F.collect_set("fact_id")).alias("_e"),
        ).where(F.col("count") >= rule.least).withColumn("group", F.col("subject"))
        return _finding(df, rule, F.col("subject"), F.col("_e"), F.array("subject"))
    if rule.kind == "aggregate":
        missing = F.lit(False)
        for k in rule.keys:
            missing = missing | attribute(own, k).isNull()
        df = own.where(~missing).where(F.expr(rule.where)).groupBy(*(attribute(own, k).alias(k) for k in rule.keys)).agg(
            F.countDistinct(attribute(own, rule.column)).alias("distinct"), F.count(F.lit(1)).alias("count"),
            F.sort_array(F.collect_set("fact_id")).alias("_e"),
        ).where((F.col("distinct") >= rule.least) & F.expr(rule.having))
        return _finding(df, rule, F.concat_ws("|", *rule.keys), F.col("_e"), F.array(rule.keys[0]))
    first, rest = rule.inputs[0], list(rule.inputs[1:])
    a = facts.where(F.col("kind") == first)
    b = facts.where(F.col("kind").isin(*rest))
    pick = lambda df, s: df.select(*(F.col(c).alias(f"{s}_{c}") for c in df.columns))
    cond = re.sub(r"\b([ab])\.(\w+)", r"\1_\2", rule.where)
    # Without an equality every pair is tried, which is fair only if one side is a handful.
    b = F.broadcast(b) if b.limit(FEW + 1).count() <= FEW else b
    met = pick(a, "a").join(pick(b, "b"), F.expr(cond))
    if rule.kind == "join":
        return _finding(met, rule, F.concat_ws("-", "a_fact_id", "b_fact_id"), F.array("a_fact_id", "b_fact_id"), F.array("a_subject"))
    keep = [c for c in met.columns if c.startswith("a_")]
    df = met.groupBy(*keep).agg(
        F.array_join(F.sort_array(F.collect_set("b_kind")), ", ").alias("capabilities"), F.sort_array(F.collect_set("b_fact_id")).alias("_e")
    )
    return _finding(df, rule, F.col("a_fact_id").cast("string"), F.concat(F.array("a_fact_id"), F.col("_e")), F.array("a_subject"))


def evaluate_facts(rules: list[Rule], facts: DataFrame) -> DataFrame:
    """The findings of rules of kind fact, all of them in one pass: each fact is tried against the
    rules of its kind."""
    own = facts.where(F.col("kind").isin(sorted({k for r in rules for k in r.inputs})))
    tried = [
        F.when(
            F.col("kind").isin(*r.inputs) & F.expr(r.where),
            F.struct(
                (rendered(own, r.finding) if r.finding else F.concat_ws(":", F.lit(r.id), "fact_id")).alias("finding_id"), F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"),
                rendered(own, r.title or r.id).alias("title"), default_confidence(F.lit(r.category)).alias("confidence"),
                F.array(*map(F.lit, r.tags)).cast("array<string>").alias("tags"), F.lit(r.version).alias("rule_version"), F.lit(r.visibility).alias("visibility"),
                resolved(F.array(*[rendered(own, a) for a in r.affects] or ["subject"])).alias("affects"),
            ),
        )
        for r in rules
    ]
    hit = own.select("fact_id", F.explode(F.array_compact(F.array(*tried))).alias("r"))
    return hit.select(
        "r.finding_id", "r.rule_id", "r.severity", "r.category", "r.title", "r.confidence",
        F.array("fact_id").alias("evidence"), "r.affects", "r.tags", "r.rule_version", "r.visibility",
    )


def run_pack(rules: list[Rule], facts: DataFrame) -> DataFrame:
    """All findings of a pack, legacy rules capped."""
    plain = [r for r in rules if r.kind == "fact"]
    found = [evaluate_facts(plain, facts)] if plain else []
    found += [evaluate(r, facts) for r in rules if r.kind != "fact"]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return legacy_capped(out)


def with_related(findings: DataFrame, related: DataFrame, key: str = "subject", relation: str = "context") -> DataFrame:
    """(finding_id, fact_id, relation) edges: each finding's own evidence, and the related facts
    that share a component with it."""
    own = findings.select("finding_id", F.explode("evidence").alias("fact_id"), F.lit("supports").alias("relation"))
    of = findings.select("finding_id", F.explode("affects").alias(key)).join(related.select(key, "fact_id"), key)
    return own.unionByName(of.select("finding_id", "fact_id", F.lit(relation).alias("relation"))).distinct()


def pack_evidence(rules: list[Rule], facts: DataFrame, findings: DataFrame) -> DataFrame:
    """(finding_id, fact_id, relation, weight), each once: the facts that a pack's findings cite,
    and the related facts of rules that ask for them, by the path that the finding is about."""
    own = findings.select("finding_id", F.explode("evidence").alias("fact_id"), F.lit("supports").alias("relation"), F.lit(1.0).alias("weight"))
    spark = facts.sparkSession
    asks = spark.createDataFrame([(r.id, r.related) for r in rules if r.related], "rule_id string, kind string")
    about = findings.join(F.broadcast(asks), "rule_id").select("finding_id", "kind", F.explode("affects").alias("path")).distinct()
    more = about.join(facts.select("kind", "path", "fact_id"), ["kind", "path"])
    return own.unionByName(more.select("finding_id", "fact_id", F.lit("conflicts_with").alias("relation"), F.lit(0.8).alias("weight"))).distinct()


def traced_pack(rules: list[Rule], facts: DataFrame) -> tuple[DataFrame, Callable[[], list[tuple[str, int, int]]]]:
    """run_pack(), counted as it runs: the findings, and what, after an action on them, tells (rule_id,
    n_in, n_out) of each rule, its kinds' facts and its findings. The pass over all facts counts
    kinds, what comes out is counted by rule, and no fact is read for the trace alone."""
    kinds = sorted({k for r in rules for k in r.inputs})
    seen, made = Observation(), Observation()
    plain = [r for r in rules if r.kind == "fact"]
    # Counted before the rules' own filters, in the branch that reads the facts once.
    counted = facts.observe(seen, *[F.count_if(F.col("kind") == k).alias(f"n{i}") for i, k in enumerate(kinds)])
    out = evaluate_facts(plain or [Rule("none", "fact", tuple(kinds), "info", "false")], counted)
    for r in rules:
        if r.kind != "fact":
            out = out.unionByName(evaluate(r, facts))
    out = legacy_capped(out).observe(made, *[F.count_if(F.col("rule_id") == r.id).alias(f"n{i}") for i, r in enumerate(rules)])

    def told() -> list[tuple[str, int, int]]:
        n = {k: seen.get[f"n{i}"] for i, k in enumerate(kinds)}
        return [(r.id, sum(n[k] for k in set(r.inputs)), made.get[f"n{i}"]) for i, r in enumerate(rules)]

    return out, told


def _counted(rule: Rule, facts: DataFrame) -> DataFrame:
    """One row (n): how many findings evaluate() gives. Pairs are counted from the different values
    that the condition reads on either side, and never listed."""
    if rule.kind not in ("join", "correlation"):
        return evaluate(rule, facts).agg(F.count(F.lit(1)).alias("n"))
    cond = re.sub(r"\b([ab])\.(\w+)", r"\1_\2", rule.where)
    read = {s: sorted(set(re.findall(rf"\b{s}\.(\w+)", rule.where))) for s in "ab"}
    side = lambda s, kinds: facts.where(F.col("kind").isin(*kinds)).select(*(F.col(c).alias(f"{s}_{c}") for c in facts.columns))
    each = lambda s, df: df.groupBy(*(f"{s}_{c}" for c in read[s])).agg(F.count(F.lit(1)).alias(f"n_{s}"))
    a, b = side("a", rule.inputs[:1]), each("b", side("b", rule.inputs[1:]))
    b = F.broadcast(b) if b.limit(FEW + 1).count() <= FEW else b
    if rule.kind == "correlation":
        return a.join(b, F.expr(cond), "left_semi").distinct().agg(F.count(F.lit(1)).alias("n"))
    met = each("a", a).join(b, F.expr(cond))
    return met.agg(F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).alias("n"))


def counted_pack(rules: list[Rule], facts: DataFrame) -> DataFrame:
    """(rule_id, n_in, n_out) of each rule, its kinds' facts and its findings, as traced_pack() tells
    them, without making the findings: their pairs may grow with the square of the facts."""
    kinds = sorted({k for r in rules for k in r.inputs})
    hits = [F.count_if(F.col("kind").isin(*r.inputs) & F.expr(r.where)).alias(f"r{i}") for i, r in enumerate(rules) if r.kind == "fact"]
    out = facts.agg(*[F.count_if(F.col("kind") == k).alias(f"n{i}") for i, k in enumerate(kinds)], *hits)
    for i, r in enumerate(rules):
        if r.kind != "fact":
            out = out.crossJoin(F.broadcast(_counted(r, facts).withColumnRenamed("n", f"r{i}")))
    n_in = lambda r: sum((F.col(f"n{kinds.index(k)}") for k in set(r.inputs)), F.lit(0).cast("long"))
    told = [F.struct(F.lit(r.id).alias("rule_id"), n_in(r).alias("n_in"), F.col(f"r{i}").alias("n_out")) for i, r in enumerate(rules)]
    return out.select(F.inline(F.array(*told)))


_COLLISION, _CONFLICT = "resource_collision", "resource-conflict:{attr:class}:{subject}"
_LOADERS = "('fabric', 'quilt', 'forge', 'neoforge')"
_CAPABLE = ("uses_process_spawn", "uses_unsafe", "uses_dynamic_class_definition", "uses_script_engine")


def _resource(id_: str, severity: str, where: str, related: str = "", tags: tuple[str, ...] = ()) -> Rule:
    """A rule of one class of collision; the class is a tag."""
    tags = ("resource", *(tags or (where.split("'")[1],)))
    return Rule(id_, "fact", (_COLLISION,), severity, where, "{subject} is written by several", "resource", finding=_CONFLICT, related=related, tags=tags)


#: Each core rule's id, what it reads, when it holds, how bad that is, its category,
#: the id of what it finds, whom that concerns, its tags and how far it is shown.
CORE = [
    Rule("duplicate-id", "distinct", ("mod", "plugin"), "error", category="metadata", column="file", finding="duplicate-id:{group}", title="{group} is shipped by {values}", tags=("metadata", "duplicate")),
    Rule("known-incompatible-mods", "join", ("mod_relationship", "mod"), "error",
         "a.related = b.subject and a.type = 'known_incompatible' and a.subject < a.related and a.archive <> b.file", category="metadata", finding="known-incompatible:{a.subject}->{a.related}", tags=("incompatible", "relationship"), affects=("{a.subject}", "{a.related}")),
    Rule("loader-mismatch", "join", ("mod", "environment"), "error",
         f"a.subject is not null and (a.identity_certainty is null or a.identity_certainty <> 'undecidable') and a.loader in {_LOADERS} and b.loader in {_LOADERS} and a.loader <> b.loader",
         category="loader", finding="loader-mismatch:{a.subject}", tags=("loader", "mismatch")),
    Rule("side-mismatch-client-on-server", "join", ("mod_side", "environment"), "warn", "a.side = 'client' and b.side = 'server'", category="loader", finding="side-mismatch:{a.subject}", tags=("side",)),
    Rule("side-mismatch-server-on-client", "join", ("mod_side", "environment"), "note", "a.side = 'server' and b.side = 'client'", category="loader", finding="side-mismatch:{a.subject}", tags=("side",)),
    _resource("resource-conflict-safe-crdt-merge", "note", "class = 'safe-crdt-merge'", "resource_writer", ("safe-crdt-merge", "safe-merge")),
    _resource("resource-conflict-json-merge", "warn", "class = 'json-merge-candidate'", "resource_writer"),
    _resource("resource-conflict-unsafe-replace", "warn", "class = 'unsafe-replace'", "resource_writer"),
    _resource("resource-conflict-tag-replace", "warn", "class = 'tag-replace-order-dependent'", "resource_writer"),
    _resource("resource-conflict-tag-mixed-required", "note", "class = 'tag-mixed-required'", "resource_writer"),
    _resource("resource-conflict-tag-invalid", "warn", "class = 'tag-invalid'", "resource_writer"),
    _resource("resource-conflict-json-override", "warn", "class = 'json-override'", "resource_writer"),
    _resource("resource-conflict-safe-json-object-merge", "note", "class = 'safe-json-object-merge'", tags=("safe-json-object-merge", "safe-merge")),
    _resource("resource-conflict-root-metadata", "info", "class = 'root-metadata'"),
    _resource("resource-conflict-order-dependent-atlas", "warn", "class = 'order-dependent-atlas'"),
    _resource("resource-conflict-order-dependent-sound-def", "warn", "class = 'order-dependent-sound-def'"),
    _resource("resource-conflict-order-dependent-shader", "warn", "class = 'order-dependent-shader'"),
    _resource("resource-conflict-binary-override-functional", "warn", "class = 'binary-override' and domain = 'shader'"),
    _resource("resource-conflict-binary-override-font", "warn", "class = 'binary-override' and domain = 'font'"),
    _resource("resource-conflict-binary-override-cosmetic", "note", "class = 'binary-override'"),
    _resource("resource-conflict-classification-unavailable", "warn", "class = 'classification-unavailable'", tags=("collision-observed", "classification-unavailable", "incomplete")),
    Rule("tag-replace-platform", "fact", ("security_suspect_modification",), "warn", "detail = 'platform_tag_replace'", category="resource", finding="tag-replace-platform:{subject}", tags=("resource", "tag", "replace", "semantic-override")),
    Rule("recipe-disabled-platform", "fact", ("security_suspect_modification",), "note", "detail = 'platform_recipe_disabled'", category="resource", finding="recipe-disabled-platform:{subject}", tags=("resource", "recipe", "disabled")),
    Rule("mixin-overlap-hot", "fact", ("mixin_overlap",), "note", "hot_path", category="mixin", finding="mixin-overlap:{subject}", tags=("mixin", "overlap"), visibility="verbose"),
    Rule("mixin-overlap", "fact", ("mixin_overlap",), "note", "not hot_path", category="mixin", finding="mixin-overlap:{subject}", tags=("mixin", "overlap"), visibility="verbose"),
    Rule("mixin-overwrite-hot", "fact", ("high_risk_overwrite",), "warn", "hot_path", category="mixin", finding="mixin-overwrite:{subject}->{attr:target}", tags=("mixin", "overwrite")),
    Rule("mixin-overwrite", "fact", ("high_risk_overwrite",), "warn", "not hot_path", category="mixin", finding="mixin-overwrite:{subject}->{attr:target}", tags=("mixin", "overwrite")),
    Rule("unknown-source", "fact", ("unknown_source",), "warn", category="security", finding="unknown-source:{subject}", tags=("sbom", "provenance")),
    Rule("unsigned-jar", "fact", ("signature_status",), "note", "status = 'unsigned'", category="security", finding="artifact-signature-status:unsigned:{subject}", tags=("sbom", "signature"), visibility="explain-only"),
    Rule("scan-incomplete", "fact", ("scan_truncated",), "warn", category="runtime", finding="scan-incomplete:{attr:layer}:{subject}", tags=("scan", "incomplete")),
    Rule("invalid-active-metadata", "fact", ("invalid_metadata",), "error", "active_for_instance", category="metadata", finding="invalid-active-metadata:{subject}", tags=("metadata", "descriptor")),
    Rule("corrupt-jar", "fact", ("unparseable_archive",), "warn", "failure_class = 'corrupt'", category="metadata", finding="corrupt-jar:{subject}", tags=("metadata", "corrupt")),
    Rule("sbom-security-correlation", "correlation", ("sbom", *_CAPABLE), "warn", "a.subject = b.archive and a.trust_score < 60", "{a_subject} can {capabilities}", "security",
         finding="low-trust-capability:{a.subject}", tags=("sbom", "security", "correlation")),
    Rule("forge-coremod-present", "fact", ("coremod",), "note", category="mixin", finding="coremod:{subject}:{attr:name}", tags=("coremod", "forge", "bytecode")),
]


def signal_rules(signals: list[tuple[str, str]]) -> list[Rule]:
    """One rule for each log signal (id, severity)."""
    return [Rule(f"log-{s}", "fact", ("log_signal",), sev, f"detail = '{s}'", "log shows {detail}", "logs") for s, sev in signals]


def mixed_loaders(mods: DataFrame, environments: DataFrame, loaders=("fabric", "quilt", "forge", "neoforge")) -> DataFrame:
    """One finding if no environment names a known loader and the decided mods have two or more."""
    known = environments.where(F.col("loader").isin(*loaders)).limit(1).select(F.lit(True).alias("_known"))
    decided = mods.where(F.coalesce(F.col("identity_certainty"), F.lit("")) != "undecidable").where(F.col("loader").isin(*loaders))
    found = decided.agg(F.sort_array(F.collect_set("loader")).alias("loaders")).where(F.size("loaders") >= 2)
    return found.join(known, how="left_anti").select(F.lit("mixed-loaders").alias("rule_id"), F.array_join("loaders", ", ").alias("loaders"))
