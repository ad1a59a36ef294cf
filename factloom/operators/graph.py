"""Graphs as edge tables: reachability, slices, paths, cycles and impact, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.sources.storage import scratch


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: its lineage ends there, it is computed once, where
    a checkpoint would compute it twice, and many small parts come back as few."""
    spark: SparkSession = df.sparkSession
    path = scratch(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, source: str, target: str, max_depth: int | None = None) -> DataFrame:
    """Distinct (source, target) pairs where target is reached in one step or more; null ends are
    dropped; a node reaches itself only on a cycle. Each round joins the newest pairs alone."""
    step = edges.select(F.col(source).cast("string").alias("f"), F.col(target).cast("string").alias("t"))
    step = checkpointed(step.where("f is not null and t is not null").distinct())
    known = new = step
    hop = step.select(F.col("f").alias("t"), F.col("t").alias("_t"))
    depth = 1
    while (max_depth is None or depth < max_depth) and not new.isEmpty():
        further = new.join(hop, "t").select("f", F.col("_t").alias("t")).distinct()
        new = checkpointed(further.join(known, ["f", "t"], "left_anti"))
        known = known.unionByName(new)  # each round's pairs are stored once
        depth += 1
    return known.select(F.col("f").alias(source), F.col("t").alias(target))


def slice_from(edges: DataFrame, roots: DataFrame, depth: int, most_nodes: int, most_edges: int) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, coverage): what roots reach in at most depth rounds, and one row telling
    nodes, edges and whether a budget or the depth cut it short."""
    e = edges.select(F.col("f").cast("string"), F.col("t").cast("string")).where("f is not null and t is not null").distinct()
    seen = front = checkpointed(roots.select(F.col("node").cast("string")).distinct().withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        reached = front.select(F.col("node").alias("f")).join(e, "f").select(F.col("t").alias("node")).distinct()
        front = checkpointed(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(front)
    kept = seen.orderBy("depth", "node").limit(most_nodes)
    inside = kept.select(F.col("node").alias("f")).join(e, "f")
    out = inside.select("f", "t").orderBy("f", "t").limit(most_edges)
    beyond = front.select(F.col("node").alias("f")).join(e, "f").join(seen.select(F.col("node").alias("t")), "t", "left_anti")
    cover = kept.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(out.agg(F.count(F.lit(1)).alias("edges")))
    cover = cover.crossJoin(beyond.agg((F.count(F.lit(1)) > 0).alias("deeper")))
    partial = F.col("deeper") | (F.col("nodes") >= most_nodes) | (F.col("edges") >= most_edges)
    return kept, cover.select("nodes", "edges", F.when(partial, "partial").otherwise("complete").alias("coverage"))


def shortest_paths(edges: DataFrame, start: str, max_depth: int | None = None) -> DataFrame:
    """(node, depth, path) of what start reaches; of equally short paths the smallest."""
    e = edges.select(F.col("f").cast("string"), F.col("t").cast("string")).where("f is not null and t is not null").distinct()
    spark = edges.sparkSession
    seen = front = spark.createDataFrame([(start, 0, [start])], "node string, depth int, path array<string>")
    d = 0
    while max_depth is None or d < max_depth:
        d += 1
        further = front.withColumnRenamed("node", "f").join(e, "f")
        further = further.select(F.col("t").alias("node"), F.array_append("path", F.col("t")).alias("path"))
        further = further.groupBy("node").agg(F.min("path").alias("path")).join(seen.select("node"), "node", "left_anti")
        front = checkpointed(further.select("node", F.lit(d).alias("depth"), "path"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.select("node", "depth", F.array_join("path", " > ").alias("path"))


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges without those from nodes that nothing enters, or into nodes that nothing leaves."""
    entered, left = e.select(F.col("t").alias("f")).distinct(), e.select(F.col("f").alias("t")).distinct()
    return e.join(entered, "f", "left_semi").join(left, "t", "left_semi")


def _contracted(e: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """(edges, arrivals) after nodes with a single way out went into the node that it leads to: of
    such nodes in a row those whose hash is larger than both neighbours', a third of a long row.
    arrivals: (u, v, w) for each edge u to v where v went into w; the edge is now u to w."""
    h = lambda c: F.xxhash64(c, F.lit(salt))
    single = e.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("w")).where("n = 1").select(F.col("f").alias("v"), "w")
    before = single.groupBy(F.col("w").alias("v")).agg(F.max(h("v")).alias("_b"))
    move = single.where(h("v") > h("w")).join(before, "v", "left").where(F.col("_b").isNull() | (h("v") > F.col("_b"))).select("v", "w")
    met = checkpointed(e.join(move.withColumnRenamed("v", "t"), "t", "left"))
    arrivals = met.where("w is not null").select(F.col("f").alias("u"), F.col("t").alias("v"), "w")
    kept = met.join(arrivals.select(F.col("v").alias("f")).distinct(), "f", "left_anti")
    return kept.select("f", F.coalesce("w", "t").alias("t")).where("f <> t").distinct(), arrivals


def _coloured(e: DataFrame) -> DataFrame:
    """(node, component) of nodes whose component has an edge within it. Each node takes the greatest
    label of what reaches it; a component of a label is what reaches back to the label's own node;
    found nodes go, edges between labels too, and the rest is labelled anew."""
    found = None
    while not e.isEmpty():
        label = checkpointed(e.select(F.explode(F.array("f", "t")).alias("node")).distinct().withColumn("label", F.col("node")))
        while True:
            better = e.join(label.withColumnRenamed("node", "f"), "f").groupBy(F.col("t").alias("node")).agg(F.max("label").alias("_l"))
            new = checkpointed(label.join(better, "node", "left").select("node", F.greatest("label", "_l").alias("label"), (F.col("_l") > F.col("label")).alias("moved")))
            label = new.select("node", "label")
            if new.where("moved").isEmpty():
                break
        within = e.join(label.select(F.col("node").alias("f"), F.col("label").alias("a")), "f").join(label.select(F.col("node").alias("t"), F.col("label").alias("b")), "t")
        within = checkpointed(within.where("a = b").select("f", "t", F.col("a").alias("label")))
        back = front = checkpointed(label.where("node = label").select("node", "label"))
        while not front.isEmpty():
            more = front.withColumnRenamed("node", "t").join(within, ["t", "label"]).select(F.col("f").alias("node"), "label").distinct()
            front = checkpointed(more.join(back, ["node", "label"], "left_anti"))
            back = back.unionByName(front)
        one = back.select("node", F.col("label").alias("component"))
        found = one if found is None else found.unionByName(one)
        rest = within.join(back.select(F.col("node").alias("f")), "f", "left_anti").join(back.select(F.col("node").alias("t")), "t", "left_anti")
        e = checkpointed(_trimmed(rest.select("f", "t")))
    return found if found is not None else e.select(F.col("f").alias("node"), F.col("t").alias("component"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): every node on a cycle and the smallest node of its strongly connected
    component. Nodes that can be on no cycle are trimmed, rows of nodes with one way out, or one way
    in, are contracted by a third a round, so a long ring takes rounds as its length's logarithm, and
    what is left is coloured. Contracted nodes then come back, last ones first: such a node belongs
    to the component of the one it went into if an edge comes to it from there. Each round stores
    edges, never pairs of what reaches what."""
    e = edges.select(F.col("f").cast("string"), F.col("t").cast("string")).where("f is not null and t is not null").distinct()
    e = checkpointed(e)
    own = e.where("f = t").select(F.col("f").alias("node"))
    e = checkpointed(_trimmed(e.where("f <> t")))
    log, salt, idle, n = [], 0, 0, e.count()
    while n and idle < 4:
        flip = salt % 2 == 1  # every other round contracts along the ways in
        along = e.select(F.col("t").alias("f"), F.col("f").alias("t")) if flip else e
        along, arrivals = _contracted(along, salt)
        e = checkpointed(_trimmed(along.select(F.col("t").alias("f"), F.col("f").alias("t")) if flip else along))
        log.append(arrivals)
        before, n = n, e.count()
        idle = idle + 1 if n > 0.98 * before else 0
        salt += 1
    known = checkpointed(_coloured(e))
    for arrivals in reversed(log):
        # What isn't known is a component by itself.
        of = lambda c, name: known.select(F.col("node").alias(c), F.col("component").alias(name))
        met = arrivals.join(of("u", "_u"), "u", "left").join(of("w", "_w"), "w", "left")
        joins = met.where(F.coalesce("_u", "u") == F.coalesce("_w", "w")).groupBy("v").agg(F.min(F.coalesce("_w", "w")).alias("component"), F.min("w").alias("w"))
        joins = checkpointed(joins)
        first = joins.select(F.col("w").alias("node"), "component").distinct().join(known.select("node"), "node", "left_anti")
        known = checkpointed(known.unionByName(joins.select(F.col("v").alias("node"), "component")).unionByName(first))
    alone = own.join(known.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    every = known.unionByName(alone)
    least = every.groupBy("component").agg(F.min("node").alias("_least"), F.count(F.lit(1)).alias("_n"))
    loops = own.withColumn("_loop", F.lit(True))
    return every.join(least, "component").join(loops, "node", "left").where("_n > 1 or _loop").select("node", F.col("_least").alias("component"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle): every node that reaches itself, and the smallest node of its cycles."""
    return strong_components(edges).withColumnRenamed("component", "cycle")


def mutual(edges: DataFrame) -> DataFrame:
    """Pairs a < b with edges both ways."""
    e = edges.select("f", "t").distinct()
    return e.join(e.select(F.col("t").alias("f"), F.col("f").alias("t")), ["f", "t"]).where("f < t").select(F.col("f").alias("a"), F.col("t").alias("b"))


def contradictory(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs that one table orders one way and another the other way."""
    return before.select("f", "t").distinct().join(after.select("f", "t").distinct(), ["f", "t"])


def dependents(edges: DataFrame, node: str) -> DataFrame:
    """Who needs a node: declared edges first, required only."""
    rows = edges.where((F.col("t") == node) & F.col("required"))
    return rows.select("f", "declared").distinct().orderBy(F.desc("declared"), "f")


def blast_radius(edges: DataFrame, references: DataFrame) -> DataFrame:
    """For each node: declared and implicit dependents and references by domain, absent domain:
    resource."""
    d = edges.groupBy(F.col("t").alias("node")).agg(
        F.countDistinct(F.when(F.col("declared"), F.col("f"))).alias("declared"),
        F.countDistinct(F.when(~F.col("declared"), F.col("f"))).alias("implicit"),
    )
    by = references.groupBy("node", F.coalesce("domain", F.lit("resource")).alias("domain")).agg(F.count(F.lit(1)).alias("refs"))
    return by.join(d, "node", "left").select("node", "domain", "refs", F.coalesce("declared", F.lit(0)).alias("declared"), F.coalesce("implicit", F.lit(0)).alias("implicit"))


def evidence_links(mods: DataFrame, dependencies: DataFrame, nested: DataFrame, runtime: DataFrame, owned: DataFrame) -> DataFrame:
    """(link, source, target, ordinal, fact_id), without repeats. mods: (fact_id, file, id);
    dependencies: (fact_id, file, id, dep), tied to the mod of the same file, or to the only one of
    that id; nested: (fact_id, file, inner); runtime: (fact_id, event, throwable); owned: (fact_id,
    id, method). Mods of one file are numbered from 0."""
    cols = ("link", "source", "target", "ordinal", "fact_id")
    number = F.row_number().over(W.partitionBy("file").orderBy("fact_id")) - 1
    contains = mods.select(F.lit("contains").alias("link"), F.col("file").alias("source"), F.col("id").alias("target"), number.alias("ordinal"), "fact_id")
    here = mods.select("file", "id").distinct()
    only = here.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("id", F.lit(True).alias("_only"))
    same = here.withColumn("_same", F.lit(True))
    tied = dependencies.join(same, ["file", "id"], "left").join(only, "id", "left").where("_same or _only")
    plain = lambda df, link, a, b: df.select(F.lit(link).alias("link"), F.col(a).alias("source"), F.col(b).alias("target"), F.lit(0).alias("ordinal"), "fact_id")
    out = contains.unionByName(plain(tied, "declares", "id", "dep")).unionByName(plain(nested, "embeds", "file", "inner"))
    out = out.unionByName(plain(runtime, "observed-in", "throwable", "event")).unionByName(plain(owned, "owns", "id", "method"))
    return out.select(*cols).where("source is not null and target is not null").distinct()


def evidence_paths(evidence: DataFrame, links: DataFrame, most: int = 256) -> DataFrame:
    """(finding_id, link, source, target, n_links, truncated): the links whose fact a finding
    cites, the first `most` of them."""
    met = evidence.select("finding_id", "fact_id").distinct().join(links, "fact_id")
    order = W.partitionBy("finding_id").orderBy("link", "source", "target", "ordinal", "fact_id")
    met = met.withColumns({"_r": F.row_number().over(order), "n_links": F.count(F.lit(1)).over(W.partitionBy("finding_id"))})
    return met.where(F.col("_r") <= most).select("finding_id", "link", "source", "target", "n_links", (F.col("n_links") > most).alias("truncated"))
