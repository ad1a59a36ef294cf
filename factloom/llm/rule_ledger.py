"""Quality rules as a bitmask ledger.

Each text is read once: its measurements are taken, every rule is evaluated on them, and the ledger
keeps a document's measurements beside one integer whose bit i says that rule i failed. Policies are
versioned sets of masks over those bits. Applying another policy, comparing two, or asking what a
policy would keep without one of its rules reads the ledger and never a text: ablations first count
the documents of each failure mask, then test masks.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks

#: What is measured in a text. Words are [^\x20\x09-\x0D]+, lines are what stands between line feeds.
MEASURES = (
    "n_words",
    "word_chars",  # code points in words
    "n_symbols",  # characters of [#*$%&|<>]
    "n_lines",  # lines with a word
    "n_dup_lines",  # of these, lines equal to an earlier line
    "n_repeat_words",  # words in 3-word windows that the text has twice or more
    "n_letter_words",  # words with an ASCII letter or any sign beyond ASCII
    "n_capital_words",  # words with two ASCII capitals or more and no small ASCII letter
    "n_digits",  # ASCII digits
    "n_ellipsis_lines",  # lines that end, before white space, in three points or their sign
)


@dataclass(frozen=True)
class Rule:
    """A rule's number in the mask, which never changes and is never given again, its name, and the
    SQL condition over measurements under which a document fails."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "few_letters", "10 * n_letter_words < 7 * n_words"),
    Rule(5, "short_words", "word_chars < 3 * n_words"),
    Rule(6, "long_words", "word_chars > 10 * n_words"),
    Rule(7, "capitals", "10 * n_capital_words > 3 * n_words"),
    Rule(8, "digits", "10 * n_digits > 3 * word_chars"),
    Rule(9, "ellipses", "10 * n_ellipsis_lines > 3 * n_lines"),
)


def mask(names: Iterable[str], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[n] for n in set(names))


@dataclass(frozen=True)
class Policy:
    """A version and its verdict: a document goes if it fails any rule of `hard`, or more than
    `allowed` rules of `soft`."""

    version: str
    hard: int
    soft: int = 0
    allowed: int = 0

    def keeps(self, failures: str = "failures") -> F.Column:
        return self.without(F.lit(0).cast("long"), failures)

    def without(self, removed: F.Column, failures: str = "failures") -> F.Column:
        """The verdict if the rules of a mask had not been there."""
        left = F.col(failures).bitwiseAND(F.bitwise_not(removed))
        hard = left.bitwiseAND(F.lit(self.hard).cast("long")) == 0
        return hard & (F.bit_count(left.bitwiseAND(F.lit(self.soft).cast("long"))) <= self.allowed)


BASE = mask(["few_words", "repeated_words"])
POLICIES = {
    p.version: p
    for p in (
        Policy("1", hard=BASE),
        Policy(
            "2",
            hard=BASE | mask(["symbols", "repeated_lines", "few_letters"]),
            soft=mask(["short_words", "long_words", "capitals", "digits", "ellipses"]),
            allowed=1,
        ),
    )
}
CURRENT = "2"

_BYTE = np.arange(256)
_SPACE = np.isin(_BYTE, [9, 10, 11, 12, 13, 32])
_LEADS = ((_BYTE & 0xC0) != 0x80) & ~_SPACE
_UPPER = ((_BYTE >= 65) & (_BYTE <= 90)).astype(np.uint8)
_LOWER = ((_BYTE >= 97) & (_BYTE <= 122)).astype(np.uint8)
_LETTER = _UPPER | _LOWER | (_BYTE >= 128).astype(np.uint8)
_SYMBOLS, _DIGITS = b"#*$%&|<>", b"0123456789"


def repeated(words: list[bytes]) -> int:
    """How many words stand in a window of three that comes twice or more; words are told apart by
    their bytes."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    x = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    m = len(number)
    key = x[:-2] * m + x[1:-1]
    if m >= 1 << 21:  # else three numbers fit in one
        key = np.unique(key, return_inverse=True)[1]
    _, at, count = np.unique(key * m + x[2:], return_inverse=True, return_counts=True)
    twice = count[at] > 1
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return int(covered.sum())


def measured(raw: bytes) -> tuple[int, ...]:
    """MEASURES of one whole text."""
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]]) if len(data) else data
    if not len(starts):
        return (0,) * len(MEASURES)
    of_words = lambda flags: np.add.reduceat(flags[data], starts, dtype=np.int32)
    capital = (of_words(_UPPER) > 1) & (of_words(_LOWER) == 0)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(starts),
        int(np.count_nonzero(_LEADS[data])),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated(raw.split()),
        int(np.count_nonzero(of_words(_LETTER))),
        int(np.count_nonzero(capital)),
        len(raw) - len(raw.translate(None, _DIGITS)),
        sum(x.rstrip().endswith((b"...", "…".encode())) for x in lines),
    )


def _measure(batches):
    import pyarrow as pa

    for batch in batches:
        rows = []
        for _, offsets, data in text_chunks(batch.column(batch.num_columns - 1)):
            rows += [measured(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        columns = np.array(rows, np.int64).reshape(len(rows), len(MEASURES)).T
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=["doc_id", *MEASURES])


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, MEASURES, failures): one row for each row of docs. A null text is measured as an
    empty one, repeated rows and rows without doc_id stay, other columns are ignored, and an empty
    table gives no rows. A rule whose condition is null does not fail."""
    if len({r.bit for r in rules}) < len(rules) or not all(0 <= r.bit < 63 for r in rules):
        raise ValueError("each rule needs a bit of its own, from 0 to 62")
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_measure, schema)
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("long") for r in rules]
    failures = F.lit(0).cast("long")
    for b in bits:
        failures = failures.bitwiseOR(b)
    return rows.withColumn("failures", failures)


def judged(entries: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with policy_version, base_failed and kept; the base rules hold in every policy."""
    base = F.col("failures").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return entries.withColumns(
        {"policy_version": F.lit(policy.version), "base_failed": base, "kept": ~base & policy.keeps()}
    )


def masks(entries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Documents and words of each failure mask, within the given columns: all that ablations need.
    At most 2 to the number of rules rows for each group, summed before the shuffle."""
    return entries.groupBy(*by, "failures").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_mask_words"))


def ablation(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(rule, n_failed, n_alone, words_alone, n_kept, n_kept_without): for each rule how many
    documents fail it, how many the policy drops for it alone, with their words, and how many the
    policy keeps with and without it. Base rules can be removed as any other. An empty ledger gives
    zeros."""
    one = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("own")) for r in rules]))
    spark = entries.sparkSession
    every = spark.range(1).select(one.alias("r")).select("r.*")
    had, now = policy.keeps(), policy.without(F.col("own"))
    count = lambda c, of="n_docs": F.coalesce(F.sum(F.when(c, F.col(of)).otherwise(0)), F.lit(0))
    tested = masks(entries).select("*", one.alias("r")).select("*", "r.*")
    sums = tested.groupBy("rule").agg(
        count(F.col("failures").bitwiseAND(F.col("own")) != 0).alias("n_failed"),
        count(now & ~had).alias("n_alone"),
        count(now & ~had, "n_mask_words").alias("words_alone"),
        count(had).alias("n_kept"),
        count(now).alias("n_kept_without"),
    )
    return every.join(sums, "rule", "left").select("rule", *[F.coalesce(c, F.lit(0)).alias(c) for c in sums.columns[1:]])


def changed(entries: DataFrame, old: Policy, new: Policy) -> DataFrame:
    """The ledger's rows on which two policies differ, with what each says and the rules that both
    policies name and the document fails."""
    rows = entries.withColumns({"kept_before": old.keeps(), "kept_after": new.keeps()})
    asked = F.lit(old.hard | old.soft | new.hard | new.soft).cast("long")
    return rows.where("kept_before <> kept_after").withColumn("reasons", F.col("failures").bitwiseAND(asked))


def profile(entries: DataFrame, by: str) -> DataFrame:
    """(by, n_docs, any_failed, all_failed): the masks of rules that any and that all documents of
    a group fail."""
    return entries.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_docs"), F.bit_or("failures").alias("any_failed"), F.bit_and("failures").alias("all_failed")
    )


#: The same measurements, mask and verdict for DuckDB.
_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT k, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM d
), g AS (
  SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), c AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n > 1
), r AS (
  SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM c, (SELECT unnest([0, 1, 2]) AS j) GROUP BY k
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]'))) AS BIGINT) AS n_letter_words,
    CAST(len(list_filter(w, lambda x: regexp_matches(x, '[A-Z].*[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS BIGINT) AS n_capital_words,
    CAST(length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS BIGINT) AS n_digits,
    CAST(len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS BIGINT) AS n_ellipsis_lines
  FROM w LEFT JOIN r USING (k)
), f AS (
  SELECT *, CAST({bits} AS BIGINT) AS failures FROM m
), v AS (
  SELECT *, failures & {base} <> 0 AS base_failed,
    failures & {base} = 0 AND failures & {hard} = 0 AND bit_count(failures & {soft}) <= {allowed} AS kept
  FROM f
)
"""


def _sql(policy: Policy) -> str:
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
    return _SQL.format(bits=bits, base=BASE, hard=policy.hard, soft=policy.soft, allowed=policy.allowed)


def verdict_sql(policy: Policy) -> str:
    return f"{_sql(policy)} SELECT doc_id, {', '.join(MEASURES)}, failures, '{policy.version}' AS policy_version, base_failed, kept FROM v"


def ablation_sql(policy: Policy) -> str:
    verdict = "failures & ~own & {0.hard} = 0 AND bit_count(failures & ~own & {0.soft}) <= {0.allowed}".format(policy)
    rules = ", ".join(f"('{r.name}', {1 << r.bit})" for r in RULES)
    return f"""{_sql(policy)}, t AS (
  SELECT rule, own, failures, n_words, kept AS had, {verdict} AS now FROM v, (VALUES {rules}) AS r(rule, own)
)
SELECT rule, count(*) FILTER (failures & own <> 0) AS n_failed, count(*) FILTER (now AND NOT had) AS n_alone,
  CAST(coalesce(sum(n_words) FILTER (now AND NOT had), 0) AS BIGINT) AS words_alone,
  count(*) FILTER (had) AS n_kept, count(*) FILTER (now) AS n_kept_without
FROM t GROUP BY rule"""
