"""Shapes of the plans that matter at scale."""

import re

import pytest

from touchline.plans.catalogue import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["c1_ball_players", "c2_goalkeepers", "c8_reid_candidates", "c9_duplicate_pairs", "c10_new_detections", "c13_cluster_to_team", "d26_coverage_cells"])
def test_no_cross_joins(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))


@pytest.mark.parametrize("name", ["f4_best_frames", "f5_longest_gaps", "f7_gallery", "f9_cluster_sample"])
def test_rank_filters_run_before_the_shuffle(spark, name):
    assert plan(spark, name).count("WindowGroupLimit") >= 2


def test_columns_are_pruned(spark):
    text = plan(spark, "e13_frame_windows")
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"match_id", "frame_idx"}


def test_pass_events_read_event_columns_only(spark):
    text = plan(spark, "i2_pass_events")
    scanned = re.search(r"FileScan parquet \[([^\]]*)\]", text).group(1)
    assert "event#" in scanned and "label#" not in scanned and "phase#" not in scanned


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(QUERIES)


# shuffles of the executed plan, those of the derived input included; dealt anew for each scan they were 18, 8 and 10
@pytest.mark.parametrize("name, most", [("e9_metadata_evolution", 11), ("i9_idle_sessions", 6), ("d20_fit_decisions", 5)])
def test_chained_scans_share_a_shuffle(spark, name, most):
    df = QUERIES[name](spark, SF)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("Exchange hashpartitioning" in line and "ReusedExchange" not in line for line in text.splitlines()) <= most
