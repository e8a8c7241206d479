"""Plan shape: no nested-loop or cartesian joins, no Python evaluation nodes,
filters pushed to the Parquet scan where they apply."""

import pytest

import __spark_entry__ as E
from blockflow import catalog

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.all_queries()))
def test_no_forbidden_nodes(spark, name):
    p = plan_of(E.queries()[name](spark, SF))
    for bad in FORBIDDEN:
        assert bad not in p, f"{name}: {bad}"


@pytest.mark.parametrize("name,needle", [
    ("filter_state", "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,O)"),
    ("view_in", "DataFilters: [CASE WHEN (l_returnflag"),
    ("dataset_by_state", "PartitionFilters: [isnotnull(state"),
    ("top15_county", "TakeOrderedAndProject"),
    ("crossfilter_all", "Expand"),
])
def test_expected_plan_pieces(spark, name, needle):
    df = E.queries()[name](spark, SF)
    s = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert needle in s or needle in plan_of(df), name


def test_column_pruning_on_points(spark):
    df = E.queries()["count_by_race"](spark, SF)
    s = plan_of(df)
    assert "l_orderkey" not in s and "l_shipdate" not in s


@pytest.mark.parametrize("name", ["apportion_races", "race_migration_table"])
def test_crosswalk_shuffle_reused(spark, name):
    df = E.queries()[name](spark, SF)
    df.collect()   # the final adaptive plan exists after execution
    assert "ReusedExchange" in plan_of(df), name
