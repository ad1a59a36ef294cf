"""Whether a version lies in a range, for three ways of writing ranges; unknown where undecidable.

A version becomes a key whose order is that of versions, a range a union of key intervals. Ranges are
read once each; rows are compared in the JVM.
"""

import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = re.compile(r"\d+|[a-z]+")


def parse(version: str) -> tuple | None:
    """Numbers and words in order, a release after its pre-releases; None if it has no number."""
    core, _, pre = version.strip().lower().split("+")[0].partition("-")
    if not re.fullmatch(r"v?\d+(\.\d+)*[a-z0-9.]*", core):
        return None
    nums = [int(x) for x in re.findall(r"\d+", core)][:4]
    words = [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in _PART.findall(pre)]
    return tuple(nums + [0] * (4 - len(nums))), not pre, tuple(words)


def _top(w: tuple, lead: int) -> tuple:
    return tuple(n + 1 if i == lead else n if i < lead else 0 for i, n in enumerate(w[0])), True, ()


def _term(term: str) -> tuple | None:
    """A semver term as an interval (low, with it, high, with it); None: open on a side, or, for the
    whole, not understood."""
    m = re.fullmatch(r"(\^|~|>=|<=|>|<|=)?\s*(v?\d[\w.+-]*|\*)", term.strip())
    if not m:
        return None
    op, text = m[1] or "=", m[2]
    if text == "*":
        return None, True, None, True
    if re.search(r"\.[x*]$", text):
        op, text = "~" if text.count(".") > 1 else "^", re.sub(r"\.[x*].*$", "", text)
    w = parse(text)
    if w is None:
        return None
    if op == "^":
        return w, True, _top(w, next((i for i, n in enumerate(w[0][:3]) if n), 2)), False
    if op == "~":
        return w, True, _top(w, min(text.count("."), 1)), False
    return {"=": (w, True, w, True), ">": (w, False, None, True), ">=": (w, True, None, True), "<": (None, True, w, False), "<=": (None, True, w, True)}[op]


def _met(intervals: list[tuple | None]) -> list:
    """The interval that lies in all, with a flag that one isn't understood, so that what lies in it
    is undecided."""
    low, low_in, high, high_in = None, True, None, True
    for x in (i for i in intervals if i is not None):
        if x[0] is not None and (low is None or (x[0], not x[1]) > (low, not low_in)):
            low, low_in = x[0], x[1]
        if x[2] is not None and (high is None or (x[2], x[3]) < (high, high_in)):
            high, high_in = x[2], x[3]
    return [low, low_in, high, high_in, None in intervals or not intervals]


def intervals(range_: str, dialect: str | None) -> list[list]:
    """A range as a union of [low, with it, high, with it, undecided]."""
    if dialect != "maven":
        terms = lambda choice: re.findall(r"(?:[\^~]|[<>]=?|=)?\s*[\w.*+-]+", choice)
        return [_met([_term(t) for t in terms(choice)]) for choice in range_.split("||")]
    parts = re.findall(r"[\[(][^\])]*[\])]", range_)
    if not parts:
        w = parse(range_)
        return [_met([None if w is None else (w, True, None, True)])]
    out = []
    for p in parts:
        ends = [e.strip() for e in p[1:-1].split(",")]
        keys = [parse(e) if e else None for e in ends[:2]]
        if len(ends) == 1:
            out.append(_met([None if keys[0] is None else (keys[0], True, keys[0], True)]))
        elif any(e and k is None for e, k in zip(ends[:2], keys, strict=True)):
            out.append(_met([None]))
        else:
            out.append(_met([(keys[0], p[0] == "[", keys[1], p[-1] == "]")]))
    return out


_KEY = "struct<nums:array<decimal(38,0)>,release:boolean,words:array<struct<kind:int,num:decimal(38,0),text:string>>>"
_RANGE = f"array<struct<low:{_KEY},low_in:boolean,high:{_KEY},high_in:boolean,undecided:boolean>>"


def _as_key(k: tuple | None) -> tuple | None:
    if k is None:
        return None
    return [Decimal(n) for n in k[0]], k[1], [(kind, Decimal(num), text) for kind, num, text in k[2]]


def _read_ranges(range_: str | None, dialect: str | None) -> list | None:
    if range_ is None:
        return None
    return [(_as_key(low), a, _as_key(high), b, open_) for low, a, high, b, open_ in intervals(range_, dialect)]


def key(version: Column) -> Column:
    """A version's key, null if it has no number, as parse() makes it: structs compare field by field,
    arrays element by element."""
    text = F.lower(F.regexp_replace(version, r"^\s+|\s+$", ""))
    text = F.substring_index(text, "+", 1)
    core = F.substring_index(text, "-", 1)
    pre = F.when(F.contains(text, F.lit("-")), F.regexp_replace(text, r"^[^-]*-", "")).otherwise("")
    nums = F.slice(F.transform(F.regexp_extract_all(core, F.lit(r"\d+"), 0), lambda x: x.try_cast("decimal(38,0)")), 1, 4)
    nums = F.slice(F.concat(nums, F.array_repeat(F.lit(0).cast("decimal(38,0)"), 4)), 1, 4)
    number = lambda x: x.rlike(r"^\d")
    words = F.transform(F.regexp_extract_all(pre, F.lit(r"\d+|[a-z]+"), 0), lambda x: F.struct(
        F.when(number(x), 0).otherwise(1).alias("kind"), F.when(number(x), x.try_cast("decimal(38,0)")).otherwise(0).cast("decimal(38,0)").alias("num"), F.when(number(x), "").otherwise(x).alias("text"),
    ))
    good = core.rlike(r"^v?\d+(\.\d+)*[a-z0-9.]*$")
    good = good & ~F.exists(nums, lambda x: x.isNull())  # a number of more than 38 digits is none
    return F.when(good, F.struct(nums.alias("nums"), (pre == "").alias("release"), words.alias("words")).cast(_KEY))


def with_in_range(df: DataFrame, version: str = "version", range_: str = "range", dialect: str = "dialect") -> DataFrame:
    """df with fits: true, false, or null where it can't be decided. Each distinct range is read
    once; an empty one, * and any take all; an opaque one, and a version without a number, are only
    equal or undecided. Rows are judged one by one: give different ones, and join them afterwards."""
    read = F.udf(_read_ranges, _RANGE)
    ranges = df.select(F.col(range_).alias("_range"), F.col(dialect).alias("_dialect")).distinct().withColumn("_spans", read("_range", "_dialect"))
    rows = df.withColumn("_key", key(F.col(version)))
    rows = rows.join(ranges, rows[range_].eqNullSafe(ranges["_range"]) & rows[dialect].eqNullSafe(ranges["_dialect"]), "left")
    k = F.col("_key")
    inside = lambda x: (
        (x["low"].isNull() | (x["low"] < k) | (x["low_in"] & (x["low"] == k))) & (x["high"].isNull() | (x["high"] > k) | (x["high_in"] & (x["high"] == k)))
    )
    sure, maybe = F.exists("_spans", lambda x: inside(x) & ~x["undecided"]), F.exists("_spans", lambda x: inside(x) & x["undecided"])
    known = F.when(sure, True).when(~maybe, False)
    text = F.regexp_replace(F.col(range_), r"^\s+|\s+$", "")
    free = F.col(range_).isNull() | text.isin("", "*", "any")
    opaque = k.isNull() | F.coalesce(F.col(dialect) == "opaque", F.lit(False))
    fits = F.when(free, True).when(opaque, F.when(F.col(version) == F.col(range_), True)).otherwise(known)
    return rows.withColumn("fits", fits).drop("_key", "_range", "_dialect", "_spans")


def shape(range_):
    """unconstrained, unbounded-above, exact or other."""
    r = F.trim(range_)
    return (
        F.when(r.isNull() | r.isin("", "*", "any"), "unconstrained")
        .when(r.rlike(r"^(>=?\s*[\w.+-]+|[\[(][\w.+-]*,\s*[\])])$"), "unbounded-above")
        .when(r.rlike(r"^(=?\s*\d[\w.+-]*|\[[\w.+-]+\])$"), "exact").otherwise("other")
    )
