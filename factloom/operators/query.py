"""Declarative queries: a spec of plain data turned into one chain of DataFrame calls."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.model import compared, literal, value
from factloom.operators.graph import closure

#: Table functions by name; the last registration of a name wins.
EXTERNAL: dict[str, Callable[[DataFrame], DataFrame]] = {}


def external(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    EXTERNAL[name] = fn


def predicate(df: DataFrame, p) -> Column:
    """(column, op, literal), ("col", a, op, b), ("in", column, values), ("null", column),
    ("not-null", column), ("and", ..), ("or", ..) or ("not", p). Two-valued: an unknown comparison
    is false, and its negation true."""
    head = p[0]
    if head in ("and", "or"):
        out = predicate(df, p[1])
        for q in p[2:]:
            out = out & predicate(df, q) if head == "and" else out | predicate(df, q)
        return out
    if head == "not":
        return ~predicate(df, p[1])
    if head == "null":
        return value(df, p[1])[0].isNull()
    if head == "not-null":
        return value(df, p[1])[0].isNotNull()
    if head == "in":
        shown = [literal(x)[0] for x in p[2] if x is not None]
        return F.coalesce(value(df, p[1])[0].isin(shown), F.lit(False)) if shown else F.lit(False)
    if head == "col":
        return F.coalesce(compared(p[2], value(df, p[1]), value(df, p[3])), F.lit(False))
    return F.coalesce(compared(p[1], value(df, head), literal(p[2])), F.lit(False))


def project(df: DataFrame, names: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*(F.col(f"`{n}`") if n in kinds else F.lit(None).cast("string").alias(n) for n in names))


def join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi-join on same-typed columns; null never joins. Names of the right that the left has
    become right_<name>; no keys: a cross join, meant for a tiny right side."""
    names = {c: f"right_{c}" if c in left.columns else c for c in right.columns}
    right = right.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    if not on:
        return left.crossJoin(F.broadcast(right) if right.limit(9).count() <= 8 else right)
    cond = [left[a] == right[names[b]] for a, b in on]
    return left.join(right, cond, how)


def theta(left: DataFrame, right: DataFrame, condition: str) -> DataFrame:
    """Pairs of two kinds under a condition on aliases a and b, as both fact ids and subjects.
    The optimiser takes equalities out of the condition as join keys."""
    met = left.alias("a").join(right.alias("b"), F.expr(condition))
    return met.select(
        F.col("a.fact_id").alias("left_id"), F.col("a.subject").alias("left_subject"),
        F.col("b.fact_id").alias("right_id"), F.col("b.subject").alias("right_subject"),
    )


def _number(df: DataFrame, name: str) -> Column:
    return value(df, name)[1]


def aggregate(df: DataFrame, keys: list[str], aggs: list[tuple[str, str | None, str]]) -> DataFrame:
    """aggs are (function, column, name): count counts rows; sum, min, max and avg read numbers
    only and are doubles. Keys group by display string, null apart. No rows give no rows, also
    without keys."""
    fns = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}
    cols = [F.count(F.lit(1)).alias(n) if f == "count" else fns[f](_number(df, c)).alias(n) for f, c, n in aggs]
    grouped = df.groupBy(*(value(df, k)[0].alias(k) for k in keys))
    out = grouped.agg(*cols, F.count(F.lit(1)).alias("_n"))
    return out.where("_n > 0").drop("_n")


def window(df: DataFrame, fn: str, name: str, partition: list[str], order: list[str] = (), column: str | None = None, tie: str = "fact_id") -> DataFrame:
    """row_number, rank and dense_rank in ascending order; count, sum, min, max and avg over the
    whole partition."""
    part = W.partitionBy(*(value(df, p)[0] for p in partition))
    ranked = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}
    if fn in ranked:
        by = [F.col(f"`{o}`") for o in order] + ([F.col(tie)] if fn == "row_number" and tie in df.columns else [])
        return df.withColumn(name, ranked[fn]().over(part.orderBy(*by)))
    if fn == "count":
        return df.withColumn(name, F.count(F.lit(1)).over(part))
    fns = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}
    return df.withColumn(name, fns[fn](_number(df, column)).over(part))


@dataclass
class QuerySpec:
    scan: str
    with_: dict[str, QuerySpec] = field(default_factory=dict)
    join: tuple[str, list[tuple[str, str]]] | None = None
    filters: list = field(default_factory=list)
    transitive_closure: tuple[str, str] | None = None
    group_by: list[str] | None = None
    aggregates: list[tuple[str, str | None, str]] = field(default_factory=list)
    having: list = field(default_factory=list)
    window: dict | None = None
    call_external: str | None = None
    project: list[str] | None = None

    def compile(self, scan: Callable[[str], DataFrame]) -> DataFrame:
        """scan gives the rows of a kind. A sub-query may use those before it; clauses apply in
        the order of the fields; an unknown external function passes rows through."""
        named: dict[str, DataFrame] = {}
        source = lambda n: named[n] if n in named else scan(n)
        for name, q in self.with_.items():
            named[name] = q.compile(source)
        df = source(self.scan)
        if self.join:
            df = join(df, source(self.join[0]), self.join[1])
        for p in self.filters:
            df = df.where(predicate(df, p))
        if self.transitive_closure:
            df = closure(df, *self.transitive_closure)
        if self.group_by is not None or self.aggregates:
            df = aggregate(df, self.group_by or [], self.aggregates)
        for p in self.having:
            df = df.where(predicate(df, p))
        if self.window:
            df = window(df, **self.window)
        if self.call_external:
            df = df.transform(EXTERNAL.get(self.call_external, lambda d: d))
        return project(df, self.project) if self.project else df


def row_local(spec: QuerySpec) -> bool:
    """Whether a query over appended rows is the query over the old rows and over the new ones."""
    plain = not (spec.join or spec.transitive_closure or spec.aggregates or spec.group_by or spec.having or spec.window or spec.call_external)
    return plain and all(row_local(q) for q in spec.with_.values())


def distinct_groups(df: DataFrame, column: str, least: int) -> DataFrame:
    """Subjects with at least `least` different shown values of a column; nulls don't count."""
    shown = value(df, column)[0]
    out = df.groupBy("subject").agg(
        F.countDistinct(shown).alias("n"), F.array_join(F.sort_array(F.collect_set(shown)), ", ").alias("values")
    )
    return out.where(F.col("n") >= least)


def longest_prefix(items: DataFrame, owners: DataFrame, item: str, prefix: str, owner: str, sep: str = ".") -> DataFrame:
    """Each item with the owners of its longest dotted prefix; several owners are ambiguous. The
    prefixes of an item are spelt out, so the join is by equality."""
    parts = F.split(F.col(item), f"[{sep}]")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sep))
    spelt = items.withColumn("_p", F.explode(every))
    met = spelt.join(owners.select(F.col(prefix).alias("_p"), F.col(owner).alias("_o")).distinct(), "_p")
    best = met.withColumn("_r", F.rank().over(W.partitionBy(item).orderBy(F.length("_p").desc()))).where("_r = 1")
    out = best.groupBy(item).agg(F.sort_array(F.collect_set("_o")).alias("owners"), F.max("_p").alias("prefix"))
    return out.withColumn("ambiguous", F.size("owners") > 1)


def graded_match(left: DataFrame, right: DataFrame, tiers: list[tuple[str, list[tuple[str, str]]]], left_id: str, right_id: str) -> DataFrame:
    """Pairs under the best tier of equal columns that they meet in. An id has one key for each tier,
    made of its number and the columns' values with their lengths, so one join serves all tiers; a
    pair that meets in several keys is kept under the first of them, with no grouping of pairs: each
    key has those of its id before it, mostly one, and a pair is kept if the two sides share none."""
    names = F.array(*[F.lit(n) for n, _ in tiers])

    def keyed(df: DataFrame, side: int, name: str, as_: str) -> DataFrame:
        keys = []
        for i, (_, on) in enumerate(tiers):
            values = [F.col(pair[side]).cast("string") for pair in on]
            keys.append(F.concat(F.lit(f"{i:04d}"), *[F.concat(F.lit("|"), F.length(x).cast("string"), F.lit(":"), x) for x in values]))
        own = df.select(F.col(name).alias(as_), F.explode(F.array_compact(F.array(*keys))).alias("key"))
        all_ = own.groupBy(as_).agg(F.array_sort(F.collect_set("key")).alias("_all"))
        each = all_.select(as_, "_all", F.posexplode("_all").alias("_at", "key"))
        first = F.when(F.col("_at") == 1, F.element_at("_all", 1)).alias(f"_{as_}_first")
        return each.select(as_, "key", F.col("_at").alias(f"_{as_}_at"), first, F.when(F.col("_at") > 1, F.slice("_all", 1, F.col("_at"))).alias(f"_{as_}_more"))

    tier = F.element_at(names, F.substring("key", 1, 4).cast("int") + 1).alias("quality")
    one = keyed(left, 0, left_id, "left_id")
    met = dealt_join(one.select("*", tier), keyed(right, 1, right_id, "right_id"), ["key"])
    first, more = (lambda s: F.col(f"_{s}_id_first")), lambda s: F.coalesce(f"_{s}_id_more", F.array(first(s)))
    best = (
        F.when((F.col("_left_id_at") == 0) | (F.col("_right_id_at") == 0), True)
        .when((F.col("_left_id_at") == 1) & (F.col("_right_id_at") == 1), first("left") != first("right")).otherwise(~F.arrays_overlap(more("left"), more("right")))
    )
    return met.where(best).select("left_id", "right_id", "quality")


#: Rows of a side that are broadcast, and of a key that one task holds at once otherwise;
#: and into how many rows those of a key that is broadcast are packed at most.
FEW_ROWS, BLOCK_ROWS, PACKS = 500_000, 4_096, 64


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], few: int = FEW_ROWS, block: int = BLOCK_ROWS) -> DataFrame:
    """left and right where all keys are equal, nulls equal to none, for keys of many rows on both
    sides. A right side of few rows is broadcast. Otherwise each side's rows of a key are cut into
    blocks by hash, and every pair of blocks is a key of its own, so no task has all of a hot key; of
    a row there are as many copies as the other side has blocks. Either way the right rows that meet
    the same left rows are one row with an array, so that a pair costs no search and no comparison."""
    rest = [c for c in right.columns if c not in keys]

    def packed(df: DataFrame, *by) -> DataFrame:
        return df.groupBy(*by).agg(F.collect_list(F.struct(*rest)).alias("_rows"))

    def spread(df: DataFrame) -> DataFrame:
        return df.select(*keys, *[c for c in left.columns if c not in keys], F.inline("_rows")) if rest else df

    if right.limit(few + 1).count() <= few:
        part = F.pmod(F.xxhash64(*[F.to_json(F.struct(c)) for c in rest]), F.lit(PACKS)).alias("_part") if rest else None
        return spread(left.join(F.broadcast(packed(right, *keys, part).drop("_part") if rest else right), keys))

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    cut = blocks(left, "_l").join(blocks(right, "_r"), keys).where("_l > 1 or _r > 1")
    own = lambda df, n: F.pmod(F.xxhash64(*[F.to_json(F.struct(c)) for c in df.columns if c not in keys] or [F.lit(0)]), F.coalesce(n, F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1).cast("array<bigint>"))
    a = left.join(cut, keys, "left").withColumn("_a", own(left, F.col("_l"))).withColumn("_b", every("_r")).drop("_l", "_r")
    b = right.join(cut, keys, "left").withColumn("_b", own(right, F.col("_r"))).withColumn("_a", every("_l")).drop("_l", "_r")
    return spread(a.join(packed(b, *keys, "_a", "_b") if rest else b, [*keys, "_a", "_b"]).drop("_a", "_b"))


def first_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def consensus(votes: DataFrame, keys: list[str], choice: str, least: int = 2) -> DataFrame:
    """The choice that alone has the most votes of a key, if those are at least `least`."""
    n = votes.groupBy(*keys, choice).agg(F.count(F.lit(1)).alias("votes"))
    r = n.withColumn("_r", F.rank().over(W.partitionBy(*keys).orderBy(F.desc("votes"))))
    top = r.where("_r = 1").groupBy(*keys).agg(F.max(choice).alias(choice), F.max("votes").alias("votes"), F.count(F.lit(1)).alias("_n"))
    return top.where(F.col("_n") == 1).where(F.col("votes") >= least).drop("_n")


def bounded_samples(rows: DataFrame, keys: list[str], column: str, n: int, name: str = "sample", more: str = "(+%d more)") -> DataFrame:
    """(keys, name, n_values): the first n of each group's different values, joined, and how many it
    has beyond; nulls are no values, and groups without one have no row. Of a group no more than n
    values leave a task, and the others are counted where they lie."""
    values = rows.select(*keys, F.col(column).alias("_v")).where("_v is not null").distinct()
    first = W.partitionBy(*keys).orderBy("_v")
    top = values.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n)
    shown = top.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("_v")), ", ").alias("_shown"))
    counts = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values")).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & shown[k].eqNullSafe(counts[f"_{k}"])
    head, tail = more.split("%d")
    beyond = F.concat(F.col("_shown"), F.lit(" " + head), (F.col("n_values") - n).cast("string"), F.lit(tail))
    text = F.when(F.col("n_values") > n, beyond).otherwise(F.col("_shown"))
    return shown.join(counts, same).select(*keys, text.alias(name), "n_values")
