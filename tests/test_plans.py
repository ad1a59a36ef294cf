"""What the optimiser makes of the queries: filters and columns reach the scan, partitions are
pruned, keys are found in conditions."""

from factloom.operators import facts as fa
from factloom.operators import query as q
from factloom.operators.versions import with_in_range
from factloom.plans import relational

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan_of(relational.b6_project(spark, SF))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in text
    read = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "props" not in read and "ts" not in read.replace("events", "")


def test_demanded_kinds_prune_partitions(spark, tmp_path):
    df = spark.createDataFrame([(i, f"k{i % 3}") for i in range(9)], "fact_id long, kind string")
    df.write.partitionBy("kind").parquet(str(tmp_path / "f"))
    out = fa.demanded(spark.read.parquet(str(tmp_path / "f")), ["k1"])
    assert out.count() == 3 and "(kind#" in plan_of(out).split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_conditions_give_join_keys(spark):
    text = plan_of(relational.j3_theta(spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_prefix_joins_are_by_equality(spark):
    text = plan_of(relational.j7_longest_prefix(spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_tiny_sides_are_broadcast_and_others_are_not_forced(spark):
    big = spark.range(100).withColumnRenamed("id", "a")
    assert "Cartesian" not in plan_of(q.join(big, spark.range(3).withColumnRenamed("id", "b"), []))


def test_a_kind_is_read_from_its_folder_and_gathered_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = spark.range(400).selectExpr("'r' as run_id", "id as n", "concat('k', id % 4) as kind", "cast(id as string) as s")
    facts, attrs = fa.project(rows, ["n", "s"], run_id="run_id", fact_id="n", kind="kind", subject="s", confidence="1", extractor="'t'", source_locator="'l'")
    laid = fa.write_facts(facts, attrs, "plan_test", 4)
    out = fa.kind_view(*laid, "k2", {"n": "int", "s": "str"})
    text = plan_of(out)
    assert "Exchange" not in text and text.count("PartitionFilters: [isnotnull(kind") == 2
    assert sorted(map(str, out.collect())) == sorted(map(str, fa.kind_view(facts, attrs, "k2", {"n": "int", "s": "str"}).collect()))
    whole = fa.reassemble(*laid)
    assert "Exchange" not in plan_of(whole) and whole.count() == 400
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for t in ("plan_test_facts", "plan_test_attributes"):
        spark.sql(f"DROP TABLE {t}")


def test_a_sample_holds_few_values_of_a_large_group(spark):
    rows = spark.range(10_000_000).selectExpr("concat('g', id % 1) as g", "concat('v', id) as v")
    out = q.bounded_samples(rows, ["g"], "v", 3)
    text = plan_of(out)
    assert "WindowGroupLimit" in text and "collect_set" not in text
    assert text.count("WindowGroupLimit") == 2  # once before the shuffle by group, once after it
    few = q.bounded_samples(rows.limit(50_000), ["g"], "v", 3).first()
    assert few.sample == "v0, v1, v10 (+49997 more)" and few.n_values == 50_000


def test_versions_are_compared_without_python(spark):
    rows = spark.range(10).selectExpr("concat('1.', id) as version", "'>=1.4' as range", "'semver' as dialect")
    text = plan_of(with_in_range(rows))
    python = [line for line in text.split("\n") if "EvalPython" in line]
    assert len(python) == 1 and "version" not in python[0].split("[_read_ranges(")[1]
