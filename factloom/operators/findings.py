"""Findings after the rules: merging, suppression, caveats, clusters, identity, assessment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.model import col_or_null, severity_name, severity_rank
from factloom.operators.query import bounded_samples


def _rank(name: str = "severity") -> Column:
    return severity_rank(F.col(name))


def merged(findings: DataFrame, position: str) -> DataFrame:
    """Findings of one id and payload become one: the worst severity, ties to the earliest, with
    all evidence, affects and tags. Another payload under the id gets an id of its own and an error
    tag."""
    payload = F.sha2(F.concat_ws("\x1f", "rule_id", "category", "title"), 256)
    df = findings.withColumn("_p", payload)
    best = F.max_by(F.struct("severity", "confidence", F.col(position).alias("at")), F.struct(_rank(), -F.col(position)))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    one = df.groupBy("finding_id", "_p", "rule_id", "category", "title").agg(
        best.alias("_b"), union("evidence"), union("affects"), union("tags"), F.min(position).alias("_first")
    )
    order = W.partitionBy("finding_id").orderBy("_first", "_p")
    one = one.withColumn("_n", F.row_number().over(order))
    clash = F.col("_n") > 1
    return one.select(
        F.when(clash, F.concat("finding_id", F.lit(":collision:"), F.substring("_p", 1, 12))).otherwise(F.col("finding_id")).alias("finding_id"),
        "rule_id", "category", "title", "_b.severity", "_b.confidence", "evidence", "affects",
        F.when(clash, F.array_append("tags", F.lit("id-collision"))).otherwise(F.col("tags")).alias("tags"),
    )


def folded(collisions: DataFrame, semantic: DataFrame) -> DataFrame:
    """Path collisions that a semantic finding of the same path explains go into it. Both have
    finding_id, path and evidence."""
    by = collisions.groupBy("path").agg(F.array_distinct(F.flatten(F.collect_list("evidence"))).alias("_e"))
    kept = semantic.join(by, "path", "left").withColumn(
        "evidence", F.array_sort(F.array_union("evidence", F.coalesce("_e", F.array().cast("array<long>"))))
    )
    rest = collisions.join(semantic.select("path"), "path", "left_anti")
    return kept.select("finding_id", "path", "evidence").unionByName(rest.select("finding_id", "path", F.array_sort("evidence").alias("evidence")))


#: Which facts say that a script changes a recipe or a loot table, what families of
#: findings they bear on, and which layers' cut scans leave that open.
RECIPE_SCRIPTS, LOOT_SCRIPTS = ("runtime_removed_recipe", "runtime_script_modifies_recipe"), ("runtime_removed_loot_table",)
RECIPE_FAMILIES = ("recipe-output-override", "recipe-type-override", "recipe-ingredient-override", "recipe-condition-override")
LOOT_FAMILIES = ("loot-table-output-override",)
SCRIPT_LAYERS = ("script", "resource", "resource-dynamics", "data-semantics")
SCRIPTED = " A script changes this object as it loads, so that the static conflict may never show; lowered, and kept for audit."


def object_id(path: Column) -> Column:
    """namespace:name of a document below data or assets, its registry folder and extension left out."""
    return F.when(path.rlike(r"^(data|assets)/[^/]+/[^/]+/.+"), F.regexp_replace(path, r"^(?:data|assets)/([^/]+)/[^/]+/(.+?)(?:\.[^./]+)?$", "$1:$2"))


def caveated(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """findings with runtime_coverage, what is known of scripts that could change what they are about,
    and lowered where that matters. A finding about an object, or a namespace, that a script names is
    at most a note, its confidence at most 0.7 of itself and 0.7, tagged and explained. Other findings
    about a static state of resources are at most warnings while anything changes resources at run
    time, or scripts were read in part. findings: (finding_id, category, family, conclusion, severity,
    confidence, affects, tags, explanation); facts: (kind, subject, layer, complete)."""
    kind = F.col("kind")
    some = lambda c: F.coalesce(F.max(c), F.lit(False))
    known = facts.agg(
        some((kind == "scan_truncated") & F.col("layer").isin(*SCRIPT_LAYERS) | (kind == "script_discovery_coverage") & ~F.col("complete")).alias("_partial"),
        some(kind.isin(*RECIPE_SCRIPTS, *LOOT_SCRIPTS, "mixin_runtime_resource_mutation")).alias("_mutated"), some(kind == "script_discovery_coverage").alias("_read"),
    )
    named = facts.where(kind.isin(*RECIPE_SCRIPTS, *LOOT_SCRIPTS)).select(F.when(kind.isin(*LOOT_SCRIPTS), "loot").otherwise("recipe").alias("_of"), F.col("subject").alias("_name")).distinct()
    path = F.get("affects", F.lit(0))
    rows = findings.crossJoin(F.broadcast(known))  # one row
    rows = rows.withColumns({
        "_for": F.when(F.col("family").isin(*RECIPE_FAMILIES), "recipe").when(F.col("family").isin(*LOOT_FAMILIES), "loot"),
        "_id": object_id(path), "_ns": F.when(path.rlike(r"^(data|assets)/[^/]+/"), F.split(path, "/")[1]),
    })
    for name, column in (("_by_id", "_id"), ("_by_ns", "_ns")):
        hit = named.select(F.col("_of").alias("_for"), F.col("_name").alias(column), F.lit(True).alias(name))
        rows = rows.join(hit, ["_for", column], "left")
    scripted = F.coalesce("_by_id", "_by_ns", F.lit(False))
    of_resource = F.col("category") == "resource"
    label = F.when(scripted, "exact-target-modified").when(of_resource, F.when(F.col("_partial"), "coverage-partial").when(F.col("_mutated"), "mutator-present").when(F.col("_read"), "no-mutator-evidence").otherwise("unavailable"))
    open_ = of_resource & (F.col("conclusion") == "static-resource-state") & (F.col("_partial") | F.col("_mutated"))
    rank = F.when(scripted, F.least(_rank(), F.lit(1))).when(open_, F.least(_rank(), F.lit(2))).otherwise(_rank())
    own = F.coalesce("explanation", F.lit(""))
    return rows.select(
        *[c for c in findings.columns if c not in ("severity", "confidence", "tags", "explanation")], severity_name(rank).alias("severity"),
        F.when(scripted, F.least(F.col("confidence") * 0.7, F.lit(0.7))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(scripted, F.array_union("tags", F.array(F.lit("runtime-script-caveat")))).otherwise(F.col("tags")).alias("tags"),
        F.when(scripted & ~F.contains(own, F.lit(SCRIPTED)), F.concat(own, F.lit(SCRIPTED))).otherwise(own).alias("explanation"),
        label.alias("runtime_coverage"), F.when(scripted | (rank < _rank()), "downgraded").otherwise("asserted").alias("disposition"),
    )


def writer_clusters(findings: DataFrame, least: int = 3) -> DataFrame:
    """Override findings with the same set of writers, if there are enough: (writer_key, n)."""
    return findings.groupBy(writer_key().alias("writer_key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def writer_key() -> Column:
    return F.array_join(F.sort_array("writers"), "+")


def writer_members(findings: DataFrame, least: int = 3) -> DataFrame:
    """The findings of writer_clusters(), one a row: (writer_key, finding_id)."""
    rows = findings.select(writer_key().alias("writer_key"), "finding_id")
    return rows.join(writer_clusters(findings, least).select("writer_key"), "writer_key", "left_semi")


def families(findings: DataFrame, shown: int = 3) -> DataFrame:
    """Findings by id without its instance tail: worst severity, count, sample."""
    rows = findings.withColumn("family", F.regexp_extract("finding_id", r"^(.*?)(?::[^:]*)?$", 1))
    worst = rows.groupBy("family").agg(severity_name(F.max(_rank())).alias("worst"), F.count(F.lit(1)).alias("n"))
    return worst.join(bounded_samples(rows, ["family"], "finding_id", shown).drop("n_values"), "family")


def fix_id() -> Column:
    return F.sha2(F.concat_ws("\x1f", "action", "target", "text"), 256)


def recommendations(fixes: DataFrame) -> DataFrame:
    """fixes: (finding_id, action, target, text, evidence). Equal advice once, with the number of
    its findings."""
    return fixes.groupBy(fix_id().alias("fix_id"), "action", "target", "text").agg(F.countDistinct("finding_id").alias("n"))


def recommended(fixes: DataFrame) -> DataFrame:
    """The findings of each advice and their evidence, one a row: (fix_id, finding_id, evidence)."""
    return fixes.select(fix_id().alias("fix_id"), "finding_id", F.explode_outer("evidence").alias("evidence")).distinct()


def combined_coverage(states: DataFrame, key: str) -> DataFrame:
    """complete if all are, unavailable if any is, else partial."""
    rank = F.when(F.col("state") == "complete", 0).when(F.col("state") == "unavailable", 2).otherwise(1)
    name = F.element_at(F.array(F.lit("complete"), F.lit("partial"), F.lit("unavailable")), F.max(rank) + 1)
    return states.groupBy(key).agg(name.alias("state"))


def visible(findings: DataFrame) -> DataFrame:
    """Proven merges are explained only and root metadata is for overlays, both info if below warn;
    sites of mixins are verbose if at most a note. Others keep the visibility that they have."""
    has = lambda *t: F.arrays_overlap("tags", F.array(*map(F.lit, t)))
    own = F.coalesce("visibility", F.lit("default")) if "visibility" in findings.columns else F.lit("default")
    merge, root = has("safe-merge", "safe-crdt-merge"), has("root-metadata")
    view = F.when(merge, "explain-only").when(root, "overlay-only").when(has("mixin-detail") & (_rank() < 2), "verbose").otherwise(own)
    return findings.withColumns({"visibility": view, "severity": F.when((merge | root) & (_rank() < 2), "info").otherwise(F.col("severity"))})


def severity_totals(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def explained(findings: DataFrame, evidence: DataFrame, facts: DataFrame, finding_id: str) -> DataFrame:
    """One finding's evidence with the facts and where they come from."""
    one = findings.where(F.col("finding_id") == finding_id).select("finding_id", "rule_id")
    return one.join(evidence, "finding_id").join(facts, "fact_id")


#: Of a cited fact, what is shown as it is.
SALIENT = ("diff_kind", "detail", "reason", "occurrence_id", "semantic_fingerprint")


def evidence_summary(evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """(finding_id, fact_id, kind, path, writers, classification, SALIENT): what is worth showing of
    each cited fact. The path is the fact's own, else its subject; who wrote it is its list of
    writers, else of archives, else, if it has a path of its own, its subject. facts: (fact_id, kind,
    subject, path, writers, class), and archives and SALIENT if they have them."""
    subject = F.nullif(F.col("subject"), F.lit(""))
    named = F.coalesce("writers", col_or_null(facts, "archives"))
    writers = F.coalesce(F.filter(F.transform(F.split(named, ","), lambda w: F.trim(w)), lambda w: w != ""), F.array().cast("array<string>"))
    alone = (F.size(writers) == 0) & F.col("path").isNotNull() & subject.isNotNull()
    shown = facts.select(
        "fact_id", "kind", F.coalesce("path", subject).alias("path"), F.when(alone, F.array(subject)).otherwise(writers).alias("writers"),
        F.col("class").alias("classification"), *[col_or_null(facts, c).alias(c) for c in SALIENT],
    )
    return evidence.select("finding_id", "fact_id").distinct().join(shown, "fact_id")
