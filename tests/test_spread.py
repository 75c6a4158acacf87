"""Costly work over a small file of many rows runs on all cores, not in the one task that reads it."""

import pytest
from pyspark.sql import functions as F

from keyloom.functions import text as t
from keyloom.plans import registry

SF = "/root/testdata/sf0.001"


def most_tasks(df):
    return df.rdd.getNumPartitions()


def test_repair_document_runs_on_all_cores(spark):
    assert most_tasks(registry.QUERIES["repair_document"](spark, SF)) >= spark.sparkContext.defaultParallelism


def test_style_attributes_runs_on_all_cores(spark):
    assert most_tasks(registry.QUERIES["style_attributes"](spark, SF)) >= spark.sparkContext.defaultParallelism
    x = spark.range(1).select(*[t.dash_pairs(F.lit(v).cast("array<double>")).alias(f"c{i}") for i, v in enumerate(([1.0], [1.0, 2.0], []))]).first()
    assert list(x) == [[[1.0, 1.0]], [[1.0, 2.0]], []]


@pytest.mark.parametrize("name", ["json_walk", "strip_round"])
def test_walks_run_on_all_cores(spark, name):
    assert most_tasks(registry.QUERIES[name](spark, SF)) >= spark.sparkContext.defaultParallelism


def test_encode_document_makes_no_row_for_each_command(spark):
    df = registry.QUERIES["encode_document"](spark, SF)
    assert most_tasks(df) >= spark.sparkContext.defaultParallelism
    assert "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_roundtrip_report_decodes_on_all_cores(spark):
    df = registry.QUERIES["roundtrip_report"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Window" not in plan and "collect_list" not in plan
