"""Stored runs, snapshots, profile reports, streams, and the entry's guard."""

import subprocess
import sys

from pyspark.sql import functions as F

from factloom.operators.history import save_run
from factloom.operators.query import QuerySpec, row_local
from factloom.sources import packages
from factloom.streaming.incremental import start


def test_saving_a_run_again_replaces_it_alone(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "run_id string, n int")
    for rows in ([("a", 1), ("b", 2)], [("b", 3)]):
        save_run({"runs": make(rows), "facts": make(rows)}, str(tmp_path))
    got = spark.read.parquet(f"{tmp_path}/facts")
    assert sorted((r.run_id, r.n) for r in got.collect()) == [("a", 1), ("b", 3)]


def test_snapshot_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, {"k": "v"}), (2, {})], "fact_id long, attributes map<string,string>")
    packages.write_snapshot(df, str(tmp_path / "s"))
    back = packages.read_snapshot(spark, str(tmp_path / "s"), df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_profiles_keep_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"run":"r","methods":[{"class":"a.B","method":"m","percent":7.5}],"mods":[{"id":"x","percent":1}],"spikes":[{"tick":4,"ms":90}]}\n{broken\n'
    )
    kinds = sorted(r.kind for r in packages.read_profiles(spark, str(tmp_path)).collect())
    assert kinds == ["hot_method", "hot_mod", "spark_import_failure", "tick_spike"]


def test_cyclonedx_rows_keep_a_missing_version(spark):
    df = spark.createDataFrame([("1", None, None, "l", "a.jar")], "id string, name string, version string, loader string, archive string")
    r = packages.cyclonedx_rows(df).first()
    assert (r.name, r.version, r.purl) == ("a.jar", None, "pkg:l/a.jar@?archive=a.jar")


def test_streams_of_both_kinds(spark, tmp_path):
    local = QuerySpec(scan="k", filters=[("n", ">", 1)], project=["n"])
    whole = QuerySpec(scan="k", aggregates=[("sum", "n", "s")])
    assert row_local(local) and not row_local(whole)
    for part in ([1, 2, 3], [4]):
        df = spark.createDataFrame([("k", n) for n in part], "kind string, n long")
        df.write.mode("append").parquet(f"{tmp_path}/in")
        for name, spec in (("local", local), ("whole", whole)):
            start(spark, spec, f"{tmp_path}/in", df.schema, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state").awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/local").collect()) == [2, 3, 4]
    assert spark.read.parquet(f"{tmp_path}/whole").agg(F.max("s")).first()[0] == 10.0


def test_entry_works_without_the_corpus_operators(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name.startswith('factloom.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert 'pipeline' not in names and not any(n.startswith('op') and n[2].isdigit() for n in names)\n"
        "assert len(names) > 150 and set(e.oracle_sql()) <= set(names)\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
