"""Several mods patching one target: overlaps, conflict pairs, composition, scores."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import checkpointed


def overlaps(sites: DataFrame) -> DataFrame:
    """sites: (id, mod, target, method, operation, side, hot). Targets of two mods or more; a
    method conflict needs two mods on one method whose sides can meet."""
    g = sites.groupBy("target").agg(F.countDistinct("mod").alias("mods"), F.array_join(F.sort_array(F.collect_set("operation")), ",").alias("operations"), F.bool_or("hot").alias("hot"))
    side = lambda s: F.array_sort(F.collect_set(F.when(F.col("side").isin(s, "both"), F.col("mod"))))
    m = sites.groupBy("target", "method").agg(side("client").alias("c"), side("server").alias("s"))
    m = m.groupBy("target").agg(F.bool_or((F.size("c") > 1) | (F.size("s") > 1)).alias("method_conflict"))
    return g.where("mods >= 2").join(m, "target")


def overwrites(classes: DataFrame, effects: DataFrame) -> DataFrame:
    """One row for each class, target and method of (class, targets, methods), with its effect."""
    rows = classes.select("class", F.explode("targets").alias("target"), "methods").select("class", "target", F.explode("methods").alias("method"))
    return rows.distinct().join(effects.groupBy("target", "method").agg(F.min("effect").alias("effect")), ["target", "method"], "left")


def pairs(sites: DataFrame, keys: list[str], differ: list[str] = (), least: str | None = None) -> DataFrame:
    """Pairs a < b of different mods' sites under equal keys, where the columns in differ do.
    Groups in which those are all equal never meet themselves."""
    sites = sites.select("id", *keys, *(c for c in ["mod", *differ] if c not in keys))
    unlike = F.lit(True)
    for c in ["mod", *differ]:
        unlike = unlike & (F.min(c) != F.max(c))
    sites = sites.join(sites.groupBy(*keys).agg(unlike.alias("_ok")).where("_ok").drop("_ok"), keys, "left_semi")
    a, b = sites.alias("a"), sites.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.id") < F.col("b.id")]
    on += [F.col(f"a.{c}") != F.col(f"b.{c}") for c in ["mod", *differ]]
    return a.join(b, on).select(*(F.col(f"a.{k}") for k in keys), F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def pair_classes(sites: DataFrame, keys: list[str], differ: list[str] = ()) -> DataFrame:
    """(keys, mod, differ, n): the sites of a group that no conflict can tell apart, counted. A hot
    group has one row for each class and not for each pair; its pairs are those of unlike classes."""
    known = sites
    for c in ["mod", *differ]:
        known = known.where(F.col(c).isNotNull())
    return known.groupBy(*keys, "mod", *differ).agg(F.count(F.lit(1)).alias("n"))


def pair_counts(classes: DataFrame, keys: list[str], differ: list[str] = ()) -> DataFrame:
    """(keys, n_sites, n_classes, n_pairs) of groups that have a pair: how many pairs() would give,
    from its classes by inclusion and exclusion. All pairs of a group, less those that agree in some
    column, plus those that agree in two, and so on."""
    columns, terms = ["mod", *differ], None
    classes = checkpointed(classes)  # read once for each term
    for size in range(len(columns) + 1):
        for same in combinations(columns, size):
            of = classes.groupBy(*keys, *same).agg(F.sum("n").alias("n"))
            term = of.select(*keys, (F.lit((-1) ** size) * F.expr("n * (n - 1) div 2")).alias("term"))
            terms = term if terms is None else terms.unionByName(term)
    pairs_ = terms.groupBy(*keys).agg(F.sum("term").alias("n_pairs")).where("n_pairs > 0")
    size_ = classes.groupBy(*keys).agg(F.sum("n").alias("n_sites"), F.count(F.lit(1)).alias("n_classes"))
    return size_.join(pairs_, keys).select(*keys, "n_sites", "n_classes", "n_pairs")


def composition(sites: DataFrame) -> DataFrame:
    """sites: (id, target, site, kind, priority, side). What comes of all patches of one site."""
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    g = sites.groupBy("target", "site").agg(
        n("replace").alias("r"), n("wrap").alias("w"), n("transform").alias("t"), n("guard").alias("g"), n("observe").alias("o"), F.count(F.lit(1)).alias("n"),
        (F.bool_or(F.col("side") == "client") & F.bool_or(F.col("side") == "server")).alias("apart"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "id"))), lambda x: x["id"].cast("string")), ",").alias("participants"),
    )
    cls = (
        F.when(F.col("apart") & (F.col("n") == 2), "impossible").when((F.col("r") >= 2) | ((F.col("r") >= 1) & (F.col("n") - F.col("r") - F.col("o") > 0)), "high")
        .when((F.col("w") >= 2) | (F.col("t") >= 2), "order-sensitive").when(F.col("g") >= 1, "conditional").otherwise("safe")
    )
    return g.select("target", "site", "n", cls.alias("class"), "participants")


_WORST = ("safe", "impossible", "conditional", "order-sensitive", "high")


def clusters(sites: DataFrame, failures: DataFrame) -> DataFrame:
    """For each target: failures, the worst composition of its sites, the least confidence."""
    rank = F.lit(0)
    for i, c in enumerate(_WORST):
        rank = F.when(F.col("class") == c, i).otherwise(rank)
    worst = composition(sites).groupBy("target").agg(F.max(rank).alias("_w"))
    low = sites.groupBy("target").agg(F.min("confidence").alias("confidence"))
    bad = failures.groupBy("target").agg(F.count(F.lit(1)).alias("failures"))
    name = F.element_at(F.array(*map(F.lit, _WORST)), F.col("_w") + 1)
    out = low.join(worst, "target").join(bad, "target", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    kind = F.when(F.col("failures") > 0, "confirmed").when(F.col("_w") == len(_WORST) - 1, "conflict").otherwise("overlap")
    return out.select("target", "failures", name.alias("worst"), "confidence", kind.alias("kind"))


#: How much a kind of injection weighs.
IMPACT_WEIGHTS = {
    "method-replace": 25, "call-replace": 20, "entry-hook": 15, "exit-hook": 12, "local-mutation": 10, "data-mutation": 10, "constant-mutation": 8,
}
#: What a target's subsystem adds to the reach.
SUBSYSTEMS = {"networking": 6, "class-loading": 6, "serialization": 6, "rendering": 4, "server-tick": 4, "persistence": 4}


def looked_up(c: Column, table: dict, default: int) -> Column:
    out = F.lit(default)
    for k, n in table.items():
        out = F.when(c == k, n).otherwise(out)
    return out


def risk_score() -> Column:
    """Of an overlap row with overwrite, method_conflict, returns, advanced, hot, loader, skew,
    reflection, hard_capture, priority, inherited, complex, gated (booleans), injection and
    subsystem (names, null where there are none), and effects, mods, edges, unresolved (numbers)."""
    flag = lambda c, n: F.when(F.col(c), n).otherwise(0)
    weight = F.when(F.col("injection").isNotNull(), F.least(F.lit(16), looked_up(F.col("injection"), IMPACT_WEIGHTS, 5))).otherwise(0)
    impact = F.when(F.col("overwrite"), 40).when(F.col("method_conflict"), 24).otherwise(8) + weight + flag("returns", 8) + flag("advanced", 6)
    impact = F.least(F.lit(40), impact)
    hot = F.when(F.col("hot"), 18 + F.least(3 * F.col("effects"), F.lit(6))).otherwise(0)
    reach = hot + F.least(3 * (F.col("mods") - 1), F.lit(9)) + F.least(2 * F.col("edges"), F.lit(6)) + flag("loader", 8) + looked_up(F.col("subsystem"), SUBSYSTEMS, 0)
    blast = F.least(F.lit(30), reach)
    fragility = F.least(F.lit(30), flag("skew", 14) + flag("reflection", 8) + flag("hard_capture", 8) + flag("priority", 6) + flag("inherited", 5) + flag("complex", 4))
    disjoint = ~F.col("method_conflict") & ~F.col("overwrite")
    certainty = F.greatest(F.lit(20), 100 - F.least(25 * F.col("unresolved"), F.lit(60)) - F.when(disjoint, 20).otherwise(0) - flag("gated", 25))
    raw = 0.5 * F.floor(2.5 * impact + 0.5) + 0.3 * blast / 30 * 100 + 0.2 * fragility / 30 * 100
    return F.floor(certainty / 100 * raw + 0.5).cast("int")


def floored(score: Column, failed: Column, confirmed: Column) -> Column:
    """A target's failure to apply is certain: it floors the score."""
    return F.when(failed, F.greatest(score, F.when(confirmed, 90).otherwise(55))).otherwise(score)


def complexity(mods: DataFrame) -> DataFrame:
    """mods: (mod, peak, classes, targets, sites, conflicts, hot)."""
    half = lambda c: F.floor(F.col(c) / 2)
    points = (
        F.least(half("peak"), F.lit(40)) + F.least(F.col("classes") * 2, F.lit(16)) + F.least("targets", F.lit(20)) + F.least(half("sites"), F.lit(14))
        + F.least(F.col("conflicts") * 4, F.lit(20)) + F.when(F.col("hot"), 6).otherwise(0)
    )
    return mods.select("mod", F.least(points, F.lit(100)).cast("int").alias("complexity"))


def bloat(mods: DataFrame) -> DataFrame:
    """mods: (mod, inert, total, volume); only those with something inert."""
    ratio = F.floor(F.col("inert") * 100 / F.col("total"))
    points = F.least(F.floor(ratio / 2), F.lit(50)) + F.least(F.col("inert") * 4, F.lit(30)) + F.least(F.floor(F.col("volume") / 40), F.lit(20))
    return mods.where("inert > 0").select("mod", points.cast("int").alias("bloat"))


#: How far a claim is confirmed, and how bad a failure is that is confirmed so far.
FAILURE_SEVERITY = {
    "runtime-confirmed": "error", "static-exact": "error", "static-descriptor-aware": "warn", "static-name-only": "warn",
    "heuristic-site": "note", "heuristic-class": "note", "heuristic-mod": "info", "unchecked": "info",
}


def recommended_severity(failure: Column, confirmation: Column, conclusive: Column, impact: Column) -> Column:
    """A failure by how it is confirmed, an exact one under incomplete coverage a warning only;
    anything else by its impact of 0 to 100."""
    out = F.lit("info")
    for k, s in FAILURE_SEVERITY.items():
        out = F.when(confirmation == k, F.when(~conclusive, "warn").otherwise(s) if k == "static-exact" else s).otherwise(out)
    return F.when(failure, out).when(impact >= 80, "warn").when(impact >= 40, "note").otherwise("info")


def confirmed(sites: DataFrame, failures: DataFrame) -> DataFrame:
    """Sites that a failure names, by class or by simple class name, and by injection point if the
    failure has one; an equal config makes it strong."""
    simple = lambda c: F.element_at(F.split(c, r"\."), -1)
    s, f = sites.withColumn("_k", simple(F.col("class"))).alias("s"), failures.withColumn("_k", simple(F.col("class"))).alias("f")
    met = s.join(f, F.col("s._k") == F.col("f._k")).where(F.col("f.point").isNull() | (F.col("f.point") == F.col("s.point")))
    exact = F.col("s.class") == F.col("f.class")
    short = ~F.contains(F.col("f.class"), F.lit("."))
    met = met.where(exact | short)
    return met.groupBy(F.col("s.id").alias("id")).agg(F.bool_or(F.col("s.config").eqNullSafe(F.col("f.config"))).alias("strong"))


def resource_mutation(sites: DataFrame) -> DataFrame:
    """Sites on loader classes: what they act on and how, less sure if the site is unsure."""
    part = F.when(F.col("class").contains("Tag"), "tags").when(F.col("class").contains("Recipe"), "recipes").when(F.col("class").contains("Pack"), "packs")
    effect = F.when(F.col("operation") == "replace", "replaces").when(F.col("operation") == "transform", "alters").otherwise("observes")
    sure = F.col("confidence") - F.when(F.col("confidence") < 60, 15).otherwise(0)
    return sites.withColumn("subsystem", part).where("subsystem is not null").select("id", "subsystem", effect.alias("effect"), sure.alias("confidence"))
