"""The data model: facts, attributes, findings, and how a typed value is shown and compared."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = (
    "run_id string, fact_id long, kind string, subject string, confidence float,"
    " extractor string, source_locator string, source_line int, source_inner string"
)
ATTRIBUTES = (
    "run_id string, fact_id long, key string, val_type string, val_str string, val_int long,"
    " val_float double, val_bool boolean"
)
BASE = [f.split()[0] for f in FACTS.split(",")]
#: Worst first.
SEVERITIES = ("fatal", "error", "warn", "note", "info")
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def severity_rank(c: Column) -> Column:
    """4 for fatal down to 0 for info and for anything else."""
    rank = F.lit(0)
    for i, s in enumerate(reversed(SEVERITIES)):
        rank = F.when(c == s, i).otherwise(rank)
    return rank


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(s) for s in reversed(SEVERITIES))), rank + 1)


def shown(c: Column, dtype: str) -> Column:
    """A value's display string: whole floats without a point."""
    if dtype in ("double", "float"):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def value(df: DataFrame, name: str) -> tuple[Column, Column]:
    """(display string, number or null) of a column; both null where there is no such column.
    A string column's numbers are those of <name>__num, if there is one."""
    kinds = dict(df.dtypes)
    if name not in kinds:
        return F.lit(None).cast("string"), F.lit(None).cast("double")
    c, kind = F.col(f"`{name}`"), kinds[name]
    if kind == "string":
        num = F.col(f"`{name}__num`") if f"{name}__num" in kinds else F.lit(None).cast("double")
        return c, num
    if kind == "boolean":
        return c.cast("string"), F.lit(None).cast("double")
    return shown(c, kind), c.cast("double")


def literal(x) -> tuple[Column, Column]:
    if x is None:
        return F.lit(None).cast("string"), F.lit(None).cast("double")
    if isinstance(x, bool):
        return F.lit(str(x).lower()), F.lit(None).cast("double")
    if isinstance(x, (int, float)):
        whole = float(x).is_integer() and abs(x) < 1e15
        return F.lit(str(int(x)) if whole else repr(float(x))), F.lit(float(x))
    return F.lit(x), F.lit(None).cast("double")


def compared(op: str, left: tuple[Column, Column], right: tuple[Column, Column]) -> Column:
    """= and != compare display strings; the ordered ones compare numbers with numbers and strings
    with strings, and are false for a mixture. Null where either side is null."""
    (ls, ln), (rs, rn) = left, right
    if op in ("=", "!="):
        return ls == rs if op == "=" else ls != rs
    by = {
        "<": lambda a, b: a < b,
        "<=": lambda a, b: a <= b,
        ">": lambda a, b: a > b,
        ">=": lambda a, b: a >= b,
    }[op]
    both, neither = ln.isNotNull() & rn.isNotNull(), ln.isNull() & rn.isNull()
    known = F.when(both, by(ln, rn)).when(neither, by(ls, rs)).otherwise(F.lit(False))
    return F.when(ls.isNotNull() & rs.isNotNull(), known)


def col_or_null(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(dtype)


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs SQL over the tables of sf_dir that it names."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)
