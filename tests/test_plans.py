"""Plan checks: filters reach the Parquet scan, projections prune columns."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF01


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_point_lookup_pushes_filter(spark):
    plan = _plan(E.queries()["p1_point_lookup"](spark, SF01))
    assert "EqualTo(doc_id,7)" in plan


def test_registry_scan_prunes_text(spark):
    plan = _plan(E.queries()["p2_active_models"](spark, SF01))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and all("text" not in s.split("ReadSchema")[-1] for s in scans)


def _final_plan(df):
    """The adaptive plan after execution; reused exchanges do not repeat their children."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_leaderboard_partial_aggregation(spark):
    plan = _plan(E.queries()["a2_leaderboard"](spark, SF01))
    aggs = [line for line in plan.splitlines() if "Aggregate(" in line and "keys=[model" in line]
    assert any("partial_" in line for line in aggs) and any("partial_" not in line for line in aggs)


@pytest.mark.parametrize("name", ["a2_leaderboard", "x4_complexity_row", "j7_ast_pair_similarity", "j3_model_pair_similarity",
                                  "x14_similarity_report"])
def test_one_parse(spark, name):
    assert _final_plan(E.queries()[name](spark, SF01)).count("MapInArrow") == 1


@pytest.mark.parametrize("name", ["x4_complexity_row", "a10_ast_shape"])
def test_metrics_need_no_aggregate(spark, name):
    assert "Aggregate" not in _plan(E.queries()[name](spark, SF01))


def test_card_parses_one_source(spark):
    lines = _plan(E.queries()["p5_solution_card"](spark, SF01)).splitlines()
    at = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
    assert any("Filter" in line and "o_orderkey" in line for line in lines[at:])


@pytest.mark.parametrize("name", ["a2_leaderboard", "x4_complexity_row", "j3_model_pair_similarity", "j4_generation_plan",
                                  "j6_outcome_gaps", "j7_ast_pair_similarity", "s9_cascade_delete", "p4_solution_summary"])
def test_building_a_query_runs_no_job(spark, name):
    tracker = spark.sparkContext.statusTracker()
    group = f"build-{name}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        E.queries()[name](spark, SF01)
        assert list(tracker.getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name, joins", [("j7_ast_pair_similarity", 2), ("x14_similarity_report", 5)])
def test_pairs_are_scored_where_they_are_dealt(spark, name, joins):
    """No group of its own a prompt, no pairs joined with their scores, and text and parse are spread over the tasks."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"dealt-{name}", name)
    try:
        df = E.queries()[name](spark, SF01)
        assert list(tracker.getJobIdsForGroup(f"dealt-{name}")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = _plan(df)
    assert "FlatMapGroupsInArrow" not in plan and plan.count("ArrowEvalPython") == 1
    assert sum("Join " in line for line in plan.splitlines()) <= joins and "Window" not in plan
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
    assert "REPARTITION_BY_NUM" in next(line for line in lines[at:] if "Exchange" in line)
    assert all("solution_a" not in line for line in lines if "Exchange" in line)
