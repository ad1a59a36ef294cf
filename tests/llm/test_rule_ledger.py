"""Measurements against a plain count, masks, policies, and ablations against judging anew."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.llm import rule_ledger as r

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len([x for i, x in enumerate(lines) if x in lines[:i]]),
        len(covered), sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", w)) for w in words),
        sum(len(re.findall("[A-Z]", w)) > 1 and not re.search("[a-z]", w) for w in words), len(re.findall("[0-9]", text)),
        sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines),
    )


TEXTS = [
    None, "", " \t\r\n\v\f ", "one", "a a a a", "a b c a b c", "a b c\na b c\n", "a b a b a", "x\x1cy \x85z\xa0w é…\nÉÉ DD Dd 1A 22 ...", "...\n…  \n.. .\r\n", "#*$%&|<> #a\n\n#a\n #a\n#a",
    "\n\n\n", "Ä Ö ß 漢字 \U0001f600 \x00", "10 20 30 10 20 30 4",
]


def test_measures_are_plain_counts():
    rng = random.Random(1)
    made = ["".join(rng.choices(["a", "B", "CD", "é", " ", " ", "\n", "...", "7", "#", "\t", "\x0b"], k=rng.randint(0, 90))) for _ in range(300)]
    for text in TEXTS + made:
        assert r.measured((text or "").encode()) == plain(text), text


def test_long_text_and_many_words():
    text = " ".join(f"w{i}" for i in range(400_000)) + " w0 w1 w2"
    got = dict(zip(r.MEASURES, r.measured(text.encode()), strict=True))
    assert got["n_words"] == 400_003 and got["n_repeat_words"] == 6
    assert r.repeated([b"%d" % i for i in range(1 << 21)] + [b"0", b"1", b"2"]) == 6


@pytest.fixture(scope="module")
def entries(docs):
    return r.ledger(docs).cache()


def test_one_entry_for_each_row_with_its_failures(docs, nameless, empty, entries):
    want = sorted((d.doc_id, *plain(d.text)) for d in docs.collect())
    got = entries.collect()
    assert sorted(tuple(x[:-1]) for x in got) == want
    for x in got:
        env = x.asDict()
        assert x.failures == sum(1 << q.bit for q in r.RULES if eval(q.fails, {}, env))
    assert r.ledger(nameless).where("doc_id is null").count() == 3
    assert r.judged(r.ledger(empty), r.POLICIES["2"]).count() == 0


def test_policies_and_their_changes(entries):
    one, two = r.POLICIES["1"], r.POLICIES["2"]
    for x in r.judged(entries, two).collect():
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words)
        assert x.kept == (not x.failures & two.hard and bin(x.failures & two.soft).count("1") <= two.allowed)
    flips = {x.doc_id for x in r.changed(entries, one, two).collect()}
    kept = lambda p: {x.doc_id for x in r.judged(entries, p).where("kept").collect()}
    assert flips == kept(one) ^ kept(two)
    soft = r.Policy("t", hard=0, soft=r.BASE, allowed=1)
    assert entries.where(soft.keeps()).count() == entries.where(F.bit_count(F.col("failures").bitwiseAND(F.lit(r.BASE))) < 2).count()


def test_ablation_equals_judging_without_the_rule(entries, empty):
    policy = r.POLICIES["2"]
    for x in r.ablation(entries, policy).collect():
        own = r.mask([x.rule])
        less = r.Policy("less", policy.hard & ~own, policy.soft & ~own, policy.allowed)
        assert x.n_kept == entries.where(policy.keeps()).count() and x.n_kept_without == entries.where(less.keeps()).count()
        alone = entries.where(less.keeps() & ~policy.keeps())
        assert (x.n_alone, x.words_alone) == tuple(alone.selectExpr("count(1)", "coalesce(sum(n_words), 0)").first())
        assert x.n_failed == entries.where(F.col("failures").bitwiseAND(F.lit(own)) != 0).count()
    none = r.ablation(r.ledger(empty), policy).collect()
    assert sorted(x.rule for x in none) == sorted(q.name for q in r.RULES) and not any(any(x[1:]) for x in none)


def test_profile_and_masks(entries):
    rows = entries.collect()
    whole = r.profile(entries.withColumn("one", F.lit(1)), "one").first()
    both, every = 0, -1
    for x in rows:
        both, every = both | x.failures, every & x.failures
    assert (whole.n_docs, whole.any_failed, whole.all_failed) == (len(rows), both, every)
    assert r.masks(entries).agg(F.sum("n_docs")).first()[0] == len(rows)


def test_bits_are_given_once(docs):
    with pytest.raises(ValueError):
        r.ledger(docs, (r.Rule(1, "a", "true"), r.Rule(1, "b", "true")))
    assert r.ledger(docs, (r.Rule(62, "none", "n_words > null"), r.Rule(3, "all", "true"))).select("failures").distinct().first()[0] == 8


def test_clean_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    out = r.judged(r.ledger(spark.read.parquet(f"{sf}/documents.parquet")), r.POLICIES[r.CURRENT])
    both = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    share = {x.quality: x.s for x in both.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] == 1 and share[0] < 0.05
