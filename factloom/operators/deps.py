"""Dependency analytics over mods (id, version, file) and dependencies (id, dep, range, dialect,
relation, mandatory)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import checkpointed
from factloom.operators.query import FEW_ROWS, bounded_samples, dealt_join
from factloom.operators.versions import shape, with_in_range


def model(mods: DataFrame, provided: DataFrame, declared: DataFrame, implicit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(providers, edges): who provides an id at what version, and all edges with defaults."""
    providers = mods.select("id", F.col("id").alias("provider"), "version").unionByName(provided.select("id", "provider", "version"))
    edges = declared.select("id", "dep", F.coalesce("mandatory", F.lit(True)).alias("mandatory"), F.lit("declared").alias("origin"))
    more = implicit.select("id", "dep", F.coalesce("mandatory", F.lit(False)).alias("mandatory"), F.lit("implicit").alias("origin"))
    return providers.distinct(), edges.unionByName(more).distinct()


def missing(declared: DataFrame, providers: DataFrame, platforms: list[str], plausible: DataFrame) -> DataFrame:
    """Mandatory dependencies that nobody provides; a plausible unidentified archive makes one a
    warning, an opaque range a note."""
    need = declared.where("mandatory and relation = 'requires'").where(~F.col("dep").isin(*platforms))
    out = need.join(providers.select(F.col("id").alias("dep")).distinct(), "dep", "left_anti")
    hint = plausible.select(F.col("id").alias("dep")).distinct().withColumn("_h", F.lit(True))
    sev = F.when(F.col("_h"), "warn").when(F.col("dialect") == "opaque", "note").otherwise("error")
    return out.join(hint, "dep", "left").select("id", "dep", sev.alias("severity"))


def _judged(declared: DataFrame, versions: DataFrame, judge, wanted: Column | None = None) -> DataFrame:
    """declared with what judge adds to each different (dep, range, dialect) and row of versions, which
    have a dep too: rows that ask the same are judged once. wanted: a condition on both, all rows if
    none. What is judged is stored and, if it is few, broadcast: rows of declared that meet none of it
    go before their duplicates are sought, and the others are not shuffled again."""
    asks = checkpointed(declared.select("dep", "range", "dialect").where("dep is not null").distinct())
    known = judge(asks.join(versions.distinct(), "dep")).withColumnsRenamed({c: f"_{c}" for c in ("dep", "range", "dialect")})
    known = checkpointed(known)
    same = (F.col("dep") == F.col("_dep")) & F.col("range").eqNullSafe(F.col("_range")) & F.col("dialect").eqNullSafe(F.col("_dialect"))
    same = same if wanted is None else same & wanted
    if known.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        known = F.broadcast(known)
        declared = declared.join(known, same, "left_semi")
    return declared.join(known, same).drop("_dep", "_range", "_dialect")


def met_versions(declared: DataFrame, providers: DataFrame, wanted: Column | None = None, added: dict[str, Column] | None = None) -> DataFrame:
    """declared by each provider of its dep, with (provider, version, fits, via_alias), where wanted
    holds. An id that many provide is a hot key: its different versions are few, and its providers come
    last, after columns that are added to what is judged."""
    judged = _judged(declared, providers.select(F.col("id").alias("dep"), "version"), with_in_range, wanted).withColumns(added or {})
    own = providers.select(F.col("id").alias("dep"), F.col("version").alias("_v"), "provider", (F.col("provider") != F.col("id")).alias("via_alias"))
    text = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))  # noqa: E731  null versions join too
    return dealt_join(judged.withColumn("_v", text(F.col("version"))), own.withColumn("_v", text(F.col("_v"))), ["dep", "_v"]).drop("_v")


KINDS = ("wrong-version", "incompatible", "discouraged")


def version_findings(declared: DataFrame, providers: DataFrame, kinds: tuple[str, ...] = KINDS, via_alias: bool | None = None) -> DataFrame:
    """Installed versions against ranges: wrong-version (error; optional: warn), incompatible (in
    the range of a breaks relation: error, undecidable: warn), discouraged (warn). Of some kinds only,
    or only by an alias or without one, if given: the other rows of both sides never meet."""
    if via_alias is not None:
        providers = providers.where(F.col("provider") != F.col("id") if via_alias else F.col("provider") == F.col("id"))
    rel, fits = F.col("relation"), F.col("fits")
    kind = (
        F.when((rel == "requires") & (fits == F.lit(False)), "wrong-version")
        .when((rel == "breaks") & F.coalesce(fits, F.lit(True)), "incompatible").when((rel == "discourages") & F.coalesce(fits, F.lit(True)), "discouraged")
    )
    sev = (
        F.when(kind == "wrong-version", F.when(F.col("mandatory"), "error").otherwise("warn"))
        .when(kind == "incompatible", F.when(fits.isNull(), "warn").otherwise("error")).otherwise("warn")
    )
    met = met_versions(declared, providers, kind.isin(*kinds), {"kind": kind, "severity": sev})
    return met.select("id", "dep", "provider", "version", "kind", "severity", "via_alias")


def undisclosed(implicit: DataFrame, declared: DataFrame, providers: DataFrame) -> DataFrame:
    """Implicit edges to something present that isn't declared, under any id of its provider. Whether
    one of a dep's other ids is among those that an id declares is asked from the smaller of the two
    sets, so an id with many providers isn't spread over all that declare it."""
    asked = checkpointed(declared.select("id", "dep").distinct())
    present = providers.select(F.col("id").alias("dep")).distinct()
    left = checkpointed(implicit.select("id", "dep").distinct().join(present, "dep", "left_semi").join(asked, ["id", "dep"], "left_anti"))
    needed = left.select("dep").distinct()
    mine = providers.select(F.col("id").alias("dep"), "provider").distinct()
    other = providers.select("provider", F.col("id").alias("other")).distinct().join(asked.select(F.col("dep").alias("other")).distinct(), "other", "left_semi")
    ids = checkpointed(mine.join(needed, "dep", "left_semi").join(other, "provider").where("dep <> other").select("dep", "other").distinct())
    n_ids = ids.groupBy("dep").agg(F.count(F.lit(1)).alias("_ids"))
    n_asked = asked.groupBy("id").agg(F.count(F.lit(1)).alias("_asked"))
    doubtful = checkpointed(left.join(n_ids, "dep").join(n_asked, "id"))
    by_ids = doubtful.where("_ids <= _asked").join(ids, "dep").select("id", "dep", "other")
    by_asked = doubtful.where("_ids > _asked").join(asked.withColumnRenamed("dep", "other"), "id").select("id", "dep", "other")
    known = by_ids.join(asked.withColumnRenamed("dep", "other"), ["id", "other"], "left_semi").unionByName(by_asked.join(ids, ["dep", "other"], "left_semi"))
    return left.join(known.select("id", "dep").distinct(), ["id", "dep"], "left_anti")


def range_shapes(declared: DataFrame) -> DataFrame:
    return declared.withColumn("shape", shape(F.col("range")))


def loose_and_tight(declared: DataFrame, providers: DataFrame) -> DataFrame:
    """Ranges on installed targets that take anything from some version on, or one version only."""
    r = range_shapes(declared.where("relation = 'requires'")).join(providers.select(F.col("id").alias("dep")).distinct(), "dep", "left_semi")
    kind = F.when(F.col("shape").isin("unconstrained", "unbounded-above"), "too-wide").when(F.col("shape") == "exact", "too-narrow")
    return r.withColumn("kind", kind).where("kind is not null").select("id", "dep", "kind")


def unused(declared: DataFrame, installed: DataFrame, implicit: DataFrame, references: DataFrame, truncated: bool) -> DataFrame:
    """Mandatory dependencies on something installed that no implicit edge and no package
    reference uses; none if the usage index is cut short."""
    own = declared.where("mandatory and relation = 'requires'").join(installed.select(F.col("id").alias("dep")).distinct(), "dep", "left_semi")
    for used in (implicit, references):
        own = own.join(used.select("id", "dep").distinct(), ["id", "dep"], "left_anti")
    return own.select("id", "dep").where(F.lit(not truncated))


def namespace_state(refs: DataFrame, owners: DataFrame, aliases: DataFrame, builtin: list[str], common: list[str]) -> DataFrame:
    """refs: (namespace, required). What stands behind each namespace."""
    o = owners.select("namespace").distinct().withColumn("_o", F.lit(True))
    a = aliases.select("namespace").distinct().withColumn("_a", F.lit(True))
    n = refs.groupBy("namespace").agg(F.bool_or("required").alias("_r"))
    state = (
        F.when(F.col("_o"), "present").when(F.col("_a"), "via-alias").when(F.col("namespace").isin(*builtin), "builtin")
        .when(F.col("namespace").isin(*common), "common").when(F.col("_r"), "required-missing").otherwise("optional-missing")
    )
    return n.join(o, "namespace", "left").join(a, "namespace", "left").select("namespace", state.alias("state"))


def implicit_by_namespace(refs: DataFrame) -> DataFrame:
    """refs: (namespace, required, hard, path)."""
    return refs.groupBy("namespace").agg(F.count(F.lit(1)).alias("refs"), F.bool_or("required").alias("required"), F.bool_or("hard").alias("hard"), F.min("path").alias("sample"))


def implicit_edges(refs: DataFrame, owners: DataFrame) -> DataFrame:
    """(writer, namespace, refs) for namespaces that the writer doesn't own."""
    return refs.join(owners.select("writer", "namespace").distinct(), ["writer", "namespace"], "left_anti").groupBy("writer", "namespace").agg(F.count(F.lit(1)).alias("refs"))


def implicit_missing(states: DataFrame, refs: DataFrame, shown: int = 3) -> DataFrame:
    """Missing required namespaces, each with its first users and how many more."""
    bad = states.where("state = 'required-missing'").select("namespace")
    return bounded_samples(refs.join(bad, "namespace"), ["namespace"], "writer", shown, "writers").drop("n_values")


def dangling(refs: DataFrame, definitions: DataFrame, indexed: DataFrame) -> DataFrame:
    """refs: (writer, namespace, kind, name, required, conditional). Required references whose path
    nothing in an indexed namespace defines."""
    path = F.concat("namespace", F.lit("/"), "kind", F.lit("/"), "name", F.lit(".json"))
    own = refs.where("required and not conditional").withColumn("path", path)
    return own.join(indexed.select("namespace").distinct(), "namespace", "left_semi").join(definitions.select("path").distinct(), "path", "left_anti").select("writer", "namespace", "path")


def dangling_summary(rows: DataFrame, owners: DataFrame, shown: int = 6) -> DataFrame:
    """By writer, within its own namespaces or across."""
    own = owners.select("writer", "namespace").distinct().withColumn("_o", F.lit(True))
    side = F.when(F.col("_o"), "internal").otherwise("cross")
    sided = rows.join(own, ["writer", "namespace"], "left").select("writer", side.alias("side"), "path")
    return bounded_samples(sided, ["writer", "side"], "path", shown).withColumnRenamed("n_values", "n")


def environment(votes: DataFrame) -> DataFrame:
    """votes: (artifact, loader, version). The loader if all agree; the version that alone has the
    most votes, two at least, of artifacts that name just one."""
    one = votes.groupBy("artifact").agg(F.countDistinct("version").alias("_n"), F.max("version").alias("version")).where("_n = 1")
    n = one.groupBy("version").agg(F.count(F.lit(1)).alias("votes"))
    top = n.agg(F.max("votes").alias("m"))
    best = n.join(F.broadcast(top), F.col("votes") == F.col("m")).agg(F.count(F.lit(1)).alias("_c"), F.max("version").alias("version"), F.max("votes").alias("votes"))
    best = best.select(F.when((F.col("_c") == 1) & (F.col("votes") >= 2), F.col("version")).alias("version"))
    loader = votes.agg(F.when(F.countDistinct("loader") == 1, F.max("loader")).alias("loader"))
    return loader.crossJoin(best)


def update_impact(declared: DataFrame, bumps: DataFrame) -> DataFrame:
    """bumps: (dep, old, new). What each range does when the version changes."""
    def judge(asks: DataFrame) -> DataFrame:
        old = with_in_range(asks, "old").withColumnRenamed("fits", "before")
        return with_in_range(old, "new").withColumnRenamed("fits", "after")

    both = _judged(declared, bumps, judge)
    effect: Column = (
        F.when(F.col("before").isNull() | F.col("after").isNull(), "undecidable").when(F.col("before") & ~F.col("after"), "breaks")
        .when(~F.col("before") & F.col("after"), "fixed").otherwise("same")
    )
    return both.select("id", "dep", effect.alias("effect"))
