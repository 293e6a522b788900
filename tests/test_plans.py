"""Physical plans: what must not occur in any query, and what must in some."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import common
from tidemark.operators import reconcile as rc
from tidemark.operators import retention as rt
from tidemark.plans import catalog
from tidemark.plans.registry import Inputs

FOLDER = "/root/testdata/sf0.01"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_no_pairwise_joins_and_no_python_rows(spark, name):
    found = re.findall(
        r"CartesianProduct|BroadcastNestedLoopJoin|EvalPython|InPandas|InArrow", plan_of(catalog.QUERIES[name](spark, FOLDER))
    )
    assert not found


def test_first_rows_are_limited_before_the_shuffle(spark):
    plan = plan_of(catalog.QUERIES["dedup_first"](spark, FOLDER))
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")
    assert "WindowGroupLimit" in plan


def test_filters_and_columns_reach_the_scan(spark):
    t = Inputs(spark, FOLDER)
    plan = plan_of(common.last_n(t.table("events").where("event_type = 'error'").select("event_id"), "event_id"))
    assert "EqualTo(event_type,error)" in plan
    assert re.search(r"ReadSchema: struct<event_id:bigint,event_type:string>", plan)
    assert "TakeOrderedAndProject" in plan


def test_matching_reads_old_files_only_and_shuffles_none(spark):
    plan = plan_of(catalog.QUERIES["match_files"](spark, FOLDER))
    assert re.search(r"PushedFilters: \[.*LessThanOrEqual\(ts,2024-01-\d\dT", plan)
    files = plan[plan.index("BroadcastHashJoin [host") : plan.index("BroadcastExchange")]
    assert "FileScan" in files and "Exchange hashpartitioning" not in files


def test_small_lookups_are_never_repeated(spark):
    for name in ("reconcile_rows_fnmatch", "plan_rules", "path_state", "catalog_objects", "mounts_for_rules"):
        assert "_slot" not in plan_of(catalog.QUERIES[name](spark, FOLDER)), name


def test_a_hot_key_is_split_where_the_lookup_is_large(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        paths = spark.range(40_000).select(
            F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("h"), "id")).alias("host"), F.col("id").alias("rule"),
            F.array(F.lit("/data")).alias("allowed"),
        ).repartition(8)
        listing = spark.range(40_000).select(F.concat(F.lit("h"), "id").alias("host"), F.lit("/data").alias("path"), F.lit(True).alias("is_dir"), F.lit(None).cast("string").alias("message")).repartition(4)
        state = rt.path_state(paths, listing)
        assert state.count() == 40_000
        state.write.format("noop").mode("overwrite").save()
        held = state.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
        assert held.agg(F.max("n")).first()[0] < 20_000
    finally:
        for key in settings:
            spark.conf.unset(key)


def branches(df) -> list[str]:
    """The operators of each child of the plan's first union."""
    plan = plan_of(df)
    lines = plan[plan.index("Union") :].splitlines()
    at = next(i for i, line in enumerate(lines) if ":- " in line)
    mark = lines[at].index(":- ")
    cuts = [i for i, line in enumerate(lines) if line[mark : mark + 3] in (":- ", "+- ") and not line[:mark].strip(" :+-")]
    return ["\n".join(lines[a:b]) for a, b in zip(cuts, [*cuts[1:], len(lines)], strict=True)]


def test_survivors_without_a_hit_are_not_shuffled(spark):
    clear, hit = branches(catalog.QUERIES["retention_survivors"](spark, FOLDER))[:2]
    own = clear[: clear.index("BroadcastExchange")]
    assert "FileScan parquet" in clear and "BroadcastHashJoin" in own and "hashpartitioning" not in own and "SortMergeJoin" not in clear
    assert "LeftAnti" in hit


def test_matches_are_made_once_for_samples_and_files_read_once_for_empty_directories(spark):
    assert "FileScan" not in plan_of(catalog.QUERIES["rule_samples"](spark, FOLDER))
    files = spark.read.parquet(f"{FOLDER}/pages.parquet").selectExpr("url AS host", "url AS path")
    gone = spark.createDataFrame([("h", "/p")], "host string, path string")
    assert plan_of(rt.directory_counts(files, gone)).count("FileScan") == 1


def test_a_comparison_reads_each_side_once(spark, tmp_path):
    """Nothing of the sides is left to read after the one pass; that pass itself reads each of them once."""
    for name in ("reconcile_rows_fnmatch", "reconcile_summary"):
        plan = plan_of(catalog.QUERIES[name](spark, FOLDER))
        assert "o_orderkey" not in plan and "l_extendedprice" not in plan
    tags = "repository string, tag string, digest string"
    spark.createDataFrame([("r", "t", "d")], tags).write.parquet(str(tmp_path / "tags"))
    sides = spark.read.parquet(str(tmp_path / "tags"))
    reads = []
    frame = type(sides)
    checkpoint = frame.checkpoint
    try:
        frame.checkpoint = lambda self, *a, **k: (reads.append(plan_of(self).count("FileScan")), checkpoint(self, *a, **k))[1]
        rc._pairs(sides, sides, "role"), rc._pairs(sides, sides, "script")
    finally:
        frame.checkpoint = checkpoint
    assert reads == [2, 2]
