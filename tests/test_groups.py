"""Groups of any size are never collected into one row."""

import hashlib
from collections import Counter

from factloom.operators import findings as fi
from factloom.operators import resources as r
from factloom.operators import trust as t


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def merkle(lines):
    """Counted digests by ranges of their first four digits, those by two, those in one."""
    nodes = [(h[:4], f"{h}:{n}") for h, n in Counter(map(sha, lines)).items()]
    for width in (2, 0):
        ranges = {}
        for r, d in nodes:
            ranges.setdefault(r, []).append(d)
        nodes = [(r[:width], f"{r}={sha(''.join(sorted(ds)))}") for r, ds in ranges.items()]
    return sha("".join(sorted(d for _, d in nodes)))


def test_lock_digest_is_made_from_ranges_of_hashes(spark):
    rows = [(i % 3 or None, str(i % 25_000), f"v{i % 5}", "f") for i in range(30_000)]
    df = spark.createDataFrame(rows, "k int, id string, version string, file string").repartition(7)
    out = t.lock_digest(df, ["k"])
    lines = {}
    for k, *parts in rows:
        lines.setdefault(k, []).append("\x1f".join(parts))
    assert {r.k: r.digest for r in out.collect()} == {k: merkle(v) for k, v in lines.items()}
    gathered = [x for x in plan_of(out).split("\n") if "collect_list" in x]
    assert len(gathered) == 3 and sum("_range" in x.split("]")[0] for x in gathered) == 2  # the last has at most 256 rows


def test_clusters_and_advice_give_members_as_rows(spark):
    found = spark.createDataFrame([(str(i), ["b", "a"] if i < 4 else ["c"]) for i in range(6)], "finding_id string, writers array<string>")
    assert "collect" not in plan_of(fi.writer_clusters(found))
    assert [tuple(r) for r in fi.writer_clusters(found).collect()] == [("a+b", 4)]
    assert sorted(r.finding_id for r in fi.writer_members(found).collect()) == ["0", "1", "2", "3"]
    fixes = spark.createDataFrame([("1", "x", "y", "z", [1, 2]), ("1", "x", "y", "z", [2]), ("2", "x", "y", "z", None)], "finding_id string, action string, target string, text string, evidence array<int>")
    assert "collect" not in plan_of(fi.recommendations(fixes)) and fi.recommendations(fixes).first().n == 2
    assert Counter((r.finding_id, r.evidence) for r in fi.recommended(fixes).collect()) == Counter([("1", 1), ("1", 2), ("2", None)])


def test_semantic_diffs_copy_no_row_for_a_column(spark):
    rows = [("a", "w1", "h1", "x", None), ("a", "w2", "h2", "x", "1"), ("b", "w1", "h1", "x", "1"), ("b", "w2", "h2", "y", "2"), ("c", "w1", "h1", "x", "1"), ("c", "w1", "h2", "y", "1")]
    rows += [("d", "w1", "h1", "x", "1"), ("d", "w2", "h1", "x", "2"), ("e", "w1", None, "x", "1"), ("e", "w2", "h1", "y", "1"), ("f", None, "h1", "x", "1"), ("f", "w1", "h1", "x", "1"), ("f", "w2", "h2", "x", "2")]
    parsed = spark.createDataFrame(rows, "path string, writer string, semantic_hash string, flag string, value string")
    out = r.semantic_diffs(parsed, ["flag", "value"])
    assert sorted(map(tuple, out.collect())) == [("a", 2, "other"), ("b", 2, "flag"), ("f", 2, "value")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "SortAggregate" not in plan
