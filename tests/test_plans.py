"""Plans hold what they should at scale: pruned scans, no cross joins, no single-task windows."""

import re

import pytest
from pyspark.sql import functions as F

from tamis.operators import join, project, quality, sample, window
from tamis.queries import QUERIES
from tamis.queries.registry import table
from tamis.session import GROUP_ROWS_CONF


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark, sf):
    plan = plan_of(QUERIES["q_filter_simple"](spark, sf))
    assert "GreaterThanOrEqual(o_totalprice" in plan
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"o_orderkey", "o_totalprice", "o_orderstatus"}


def test_filter_crosses_a_join(spark, sf):
    joined = join.join(table(spark, sf, "lineitem"), table(spark, sf, "orders"), [("l_orderkey", "o_orderkey")], "INNER")
    plan = plan_of(project.filter_rows(joined, "l_quantity > 49 AND o_orderstatus = 'F'").select("l_quantity", "o_orderstatus"))
    assert "GreaterThan(l_quantity,49.0)" in plan and "EqualTo(o_orderstatus,F)" in plan
    assert "l_extendedprice" not in plan and "o_orderdate" not in plan


@pytest.mark.parametrize(
    "name",
    ["q_join_full", "q_outlier_3sigma_flag", "q_norm_zscore", "q_chart_grouped", "q_chart_heatmap", "q_kpi_breach", "q_drift_fields", "q_gate_report", "q_row_diff", "q_sample_boundary"],
)
def test_no_cross_join(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_statistics_are_a_subquery(spark, sf):
    plan = plan_of(quality.normalize(table(spark, sf, "lineitem"), "l_extendedprice", "ZSCORE"))
    assert "scalar-subquery" in plan or "Subquery" in plan
    assert "Window" not in plan


def test_keyless_window_takes_no_single_task(spark, sf):
    spark.conf.set(GROUP_ROWS_CONF, "100")
    try:
        plan = plan_of(window.window(table(spark, sf, "orders"), "n", "ROW_NUMBER", [], ["o_totalprice", "o_orderkey"]))
    finally:
        spark.conf.unset(GROUP_ROWS_CONF)
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__slice" in w or "__nth" in w or "__before" in w for w in windows)


def test_top_by_rank_prunes_before_the_shuffle(spark, sf):
    plan = plan_of(window.top_by_rank(table(spark, sf, "orders"), [("o_totalprice", "DESC")], 3, ["o_orderpriority"]))
    assert "WindowGroupLimit" in plan


def test_no_row_at_a_time_python(spark, sf):
    for name in ("q_drift_policy", "q_chart_100pct", "q_agg_percentiles", "q_similarity", "q_chain_hashes"):
        plan = plan_of(QUERIES[name](spark, sf))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_sample_result_is_stored_small(spark, sf):
    picked = sample.random_rows(table(spark, sf, "lineitem"), 100, 1)
    assert picked.count() == 100
    assert picked.agg(F.count_distinct(F.struct("*"))).first()[0] <= 100
