"""Fact tables: long attribute rows to wide kinds and back, contracts, retention and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.model import BASE, shown

_TYPES = {"string": "str", "boolean": "bool", "double": "float", "float": "float"}
_SLOTS = {"str": "val_str", "int": "val_int", "float": "val_float", "bool": "val_bool"}
_CASTS = {"str": "string", "int": "long", "float": "double", "bool": "boolean"}


def project(df: DataFrame, attributes: list[str], **base) -> tuple[DataFrame, DataFrame]:
    """Rows to (facts, attributes). base gives an expression for each base column; null attribute
    values make no attribute row, and names of base columns are left out (the base wins)."""
    given = {k: base.get(k) for k in BASE}
    cols = [
        (F.lit(None) if v is None else v if not isinstance(v, str) else F.expr(v))
        .cast({"fact_id": "long", "confidence": "float", "source_line": "int"}.get(k, "string"))
        .alias(k)
        for k, v in given.items()
    ]
    kinds = dict(df.dtypes)
    entries = []
    for name in dict.fromkeys(a for a in attributes if a not in BASE):
        t = _TYPES.get(kinds[name], "int")
        slots = [
            (F.col(name) if t == k else F.lit(None)).cast(_CASTS[k]).alias(slot)
            for k, slot in _SLOTS.items()
        ]
        entry = F.struct(F.lit(name).alias("key"), F.lit(t).alias("val_type"), *slots)
        entries.append(F.when(F.col(name).isNotNull(), entry))
    rows = df.select(*cols, F.array_compact(F.array(*entries)).alias("_a"))
    attrs = rows.select("run_id", "fact_id", F.explode("_a").alias("a")).select("run_id", "fact_id", "a.*")
    return rows.select(BASE), attrs


def shown_value():
    """An attribute row's display string."""
    return F.coalesce(
        "val_str", F.col("val_int").cast("string"), shown(F.col("val_float"), "double"), F.col("val_bool").cast("string")
    )


def number_value():
    return F.coalesce(F.col("val_int").cast("double"), "val_float")


def reassemble(facts: DataFrame, attrs: DataFrame) -> DataFrame:
    """facts with a map of attributes; of a repeated key one value stays, the smallest shown."""
    one = attrs.groupBy("run_id", "fact_id", "key").agg(
        F.min_by(F.struct("val_type", *_SLOTS.values()), shown_value()).alias("v")
    )
    maps = one.groupBy("run_id", "fact_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "v"))).alias("attributes"))
    return facts.join(maps, ["run_id", "fact_id"], "left")


def kind_view(facts: DataFrame, attrs: DataFrame, kind: str, keys: dict[str, str]) -> DataFrame:
    """One row for each fact of a kind with a column for each of keys (name to type: str, int,
    float, bool, or any: the display string, and its number as <name>__num)."""
    aggs = []
    for k, t in keys.items():
        if k in BASE:
            continue
        on = F.col("key") == k
        if t == "any":
            aggs += [F.max(F.when(on, shown_value())).alias(k), F.max(F.when(on, number_value())).alias(f"{k}__num")]
        elif t == "float":
            aggs.append(F.max(F.when(on, number_value())).alias(k))
        else:
            aggs.append(F.max(F.when(on, F.col(_SLOTS[t]))).alias(k))
    own = facts.where(F.col("kind") == kind)
    if not aggs:
        return own
    wanted = attrs.where(F.col("key").isin(list(keys)))
    if "kind" in attrs.columns:  # laid out by kind: other kinds' files are not read
        wanted = wanted.where(F.col("kind") == kind).drop("kind")
    return own.join(wanted, ["run_id", "fact_id"], "left").groupBy(*BASE).agg(*aggs)


def conformance(attrs: DataFrame, facts: DataFrame, contract: DataFrame) -> DataFrame:
    """Attribute rows whose type breaks the contract (kind, key, type); int passes for float."""
    typed = attrs.join(facts.select("run_id", "fact_id", "kind"), ["run_id", "fact_id"])
    bad = typed.join(contract, ["kind", "key"]).where("val_type <> type and not (type = 'float' and val_type = 'int')")
    return bad.select("run_id", "fact_id", "kind", "key", "val_type", "type")


def round_trip_losses(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with side and times."""
    cols = before.columns
    n = before.withColumn("_n", F.lit(1)).unionByName(after.withColumn("_n", F.lit(-1)))
    return n.groupBy(cols).agg(F.sum("_n").alias("surplus")).where("surplus <> 0")


def kind_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("run_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def demanded(facts: DataFrame, kinds: list[str]) -> DataFrame:
    """The facts of the kinds a set of plans reads; prunes partitions of a table laid out by kind."""
    return facts.where(F.col("kind").isin(kinds))


def lookup(facts: DataFrame, subject: str, kind: str | None = None) -> DataFrame:
    found = facts.where(F.col("subject") == subject)
    return found if kind is None else found.where(F.col("kind") == kind)


def retain(facts: DataFrame, cited: DataFrame, keep_kinds: list[str], most: int) -> DataFrame:
    """All facts if there are at most `most`; else those of the kinds to keep and those cited."""
    if facts.limit(most + 1).count() <= most:
        return facts
    ids = cited.select("fact_id").distinct().withColumn("_cited", F.lit(True))
    return facts.join(ids, "fact_id", "left").where(F.col("kind").isin(keep_kinds) | F.col("_cited")).drop("_cited")


def clamp(c):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def first_facts(facts: DataFrame, position: str) -> DataFrame:
    """Of repeated (run_id, fact_id) the first by position stays."""
    order = W.partitionBy("run_id", "fact_id").orderBy(position)
    return facts.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def contract_of(spark, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "kind string, key string, type string")


def write_facts(facts: DataFrame, attrs: DataFrame, name: str, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """Writes both tables, as <name>_facts and <name>_attributes, by kind and, within a kind, in buckets
    of (run_id, fact_id), and returns them. Attributes carry their fact's kind. A scan of some kinds
    reads their folders alone; facts meet their attributes, and attributes are gathered by fact,
    where they lie, without a shuffle."""
    keys = ["run_id", "fact_id"]
    out = []
    for df, part in ((facts, "facts"), (attrs.join(facts.select(*keys, "kind").distinct(), keys), "attributes")):
        table = f"{name}_{part}"
        writer = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").partitionBy("kind")
        writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
        out.append(df.sparkSession.table(table).select(df.columns))
    return out[0], out[1]
