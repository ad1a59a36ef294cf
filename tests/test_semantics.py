"""Comparison, null and grouping rules on literal rows, and round trips on random ones."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.model import compared, literal, value
from factloom.operators import facts as fa
from factloom.operators import graph as g
from factloom.operators import query as q
from factloom.operators.history import window_hours
from factloom.operators.versions import with_in_range
from tests.version_oracle import in_range


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, "a", 5.0, "5", True), (2, "b", None, None, None), (3, None, 2.5, "x", False)]
    return spark.createDataFrame(data, "fact_id long, subject string, num double, text string, flag boolean")


def ids(df):
    return sorted(r.fact_id for r in df.collect())


@pytest.mark.parametrize(
    "p,want",
    [
        (("num", "=", "5"), [1]), (("num", "=", 5), [1]), (("text", "=", 5), [1]), (("num", "!=", 5), [3]), (("flag", "=", True), [1]), (("flag", "=", "true"), [1]),
        (("num", "<", 3), [3]), (("text", "<", 3), []), (("text", ">", "4"), [1, 3]), (("num", "<", "9"), []), (("not", ("num", "=", 5)), [2, 3]),
        (("in", "num", ["5", 2.5]), [1, 3]), (("in", "num", [None]), []), (("null", "gone"), [1, 2, 3]), (("gone", "=", "x"), []), (("col", "num", "=", "text"), [1]),
    ],
)
def test_predicates(rows, p, want):
    assert ids(rows.where(q.predicate(rows, p))) == want


def test_comparison_of_nulls_is_unknown(rows):
    got = rows.select(compared("=", value(rows, "num"), literal(None)).alias("c")).collect()
    assert [r.c for r in got] == [None] * 3


def test_aggregates_read_numbers_only(rows):
    out = q.aggregate(rows, [], [("count", "text", "n"), ("min", "text", "m"), ("sum", "num", "s")]).collect()
    assert [tuple(r) for r in out] == [(3, None, 7.5)]
    assert q.aggregate(rows.where("false"), [], [("count", None, "n")]).count() == 0
    assert {r.subject: r.n for r in q.aggregate(rows, ["subject"], [("count", None, "n")]).collect()} == {"a": 1, "b": 1, None: 1}


def test_join_keeps_left_names_and_drops_null_keys(rows):
    out = q.join(rows, rows, [("subject", "subject")])
    assert out.count() == 2 and "right_num" in out.columns


def test_closure_of_cycles_and_nulls(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None), ("x", "y"), ("a", "b")], "f string, t string")
    got = {tuple(r) for r in g.closure(e, "f", "t").collect()}
    assert got == {(a, b) for a in "abc" for b in "abc"} | {("x", "y")}
    assert g.closure(e.where("false"), "f", "t").count() == 0


def test_slice_tells_what_it_left_out(spark):
    e = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)], "f string, t string")
    root = spark.createDataFrame([("0",)], "node string")
    kept, cover = g.slice_from(e, root, 4, 100, 100)
    assert kept.count() == 5 and cover.first().coverage == "partial"
    assert g.slice_from(e, root, 20, 100, 100)[1].first().coverage == "complete"


@given(st.lists(st.tuples(st.integers(0, 20), st.one_of(st.none(), st.integers(-9, 9)), st.one_of(st.none(), st.text("ab:|", max_size=3)), st.one_of(st.none(), st.booleans())), max_size=12, unique_by=lambda r: r[0]))
@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
def test_facts_round_trip(spark, data):
    df = spark.createDataFrame(data, "id long, n long, s string, b boolean")
    facts, attrs = fa.project(df, ["n", "s", "b"], run_id="'r'", fact_id="id", kind="'k'", subject="string(id)", confidence="1", extractor="'t'", source_locator="'l'")
    back = fa.kind_view(facts, attrs, "k", {"n": "int", "s": "str", "b": "bool"})
    assert sorted(map(str, back.select("fact_id", "n", "s", "b").collect())) == sorted(map(str, df.select(F.col("id").alias("fact_id"), "n", "s", "b").collect()))


@pytest.mark.parametrize(
    "version,range_,dialect,want",
    [
        ("1.2.3", ">=1.2 <2", "semver", True), ("2.0.0", "^1.1", "semver", False), ("1.2.3", "~1.2.0", "semver", True), ("1.3.0", "~1.2.0", "semver", False), ("0.2.5", "^0.2.1", "semver", True),
        ("0.3.0", "^0.2.1", "semver", False), ("1.0.0-beta", ">=1.0.0", "semver", False), ("1.5", "1.x || 3.x", "semver", True), ("2.5", "1.x || 3.x", "semver", False), ("9", "*", "semver", True),
        ("1.5", "[1.0,2.0)", "maven", True), ("2.0", "[1.0,2.0)", "maven", False), ("2.0", "(,2.0]", "maven", True), ("3", "[1],[3]", "maven", True), ("1.2", "1.1", "maven", True),
        ("what", ">=1", "semver", None), ("1.0", "odd!", "semver", None), ("abc", "abc", "opaque", True), ("abc", "abd", "opaque", None), (None, ">=1", "semver", None), ("1", None, "semver", True),
    ],
)
def test_versions(spark, version, range_, dialect, want):
    assert in_range(version, range_, dialect) is want
    row = spark.createDataFrame([(version, range_, dialect)], "version string, range string, dialect string")
    assert with_in_range(row).first().fits is want


def test_key_intervals_are_the_ranges(spark):
    """All pairs of odd and usual versions and ranges, against judging each pair by itself."""
    rng = random.Random(7)
    number = lambda: ".".join(str(rng.choice([0, 1, 2, 10, 3])) for _ in range(rng.randint(1, 5)))
    tails = ["", "", "", "-rc1", "-beta.2", "-1", "-alpha-3", "+build", "a", ".x", "-SNAPSHOT+7"]
    version = lambda: rng.choice(["", "", "v", " "]) + number() + rng.choice(tails)
    versions = [version() for _ in range(150)] + [None, "", "what", "1.x", "v", "*", "1..2"]
    term = lambda: rng.choice(["", "^", "~", ">=", "<=", "<", ">", "=", ">= "]) + version() + rng.choice(["", "", ".x", ".*"])
    semver = lambda: " || ".join(" ".join(term() for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 3)))
    end = lambda: rng.choice(["", version(), version(), "odd"])
    maven = lambda: ",".join(rng.choice("[(") + rng.choice([end(), f"{end()},{end()}", f"{end()}, {end()}"]) + rng.choice("])") for _ in range(rng.randint(1, 3)))
    ranges = [(semver(), "semver") for _ in range(150)] + [(maven(), "maven") for _ in range(150)] + [(version(), d) for d in ("maven", "opaque", None) for _ in range(20)]
    ranges += [(None, "semver"), ("*", "maven"), (" ", None), ("any", "opaque"), ("odd!", "semver"), ("*", "semver")]
    df = spark.createDataFrame([(v,) for v in versions], "version string").crossJoin(spark.createDataFrame(ranges, "range string, dialect string"))
    got = with_in_range(df).collect()
    assert len(got) == len(versions) * len(ranges)
    for r in got:
        assert r.fits is in_range(r.version, r.range, r.dialect), r
    assert {r.fits for r in got} == {True, False, None}


def test_windows():
    assert (window_hours("30d"), window_hours("24h"), window_hours("2w")) == (720, 24, 336)
    for bad in ("0d", "-1d", "3m", "d", ""):
        with pytest.raises(ValueError):
            window_hours(bad)
