"""Tables with a row per frame or box never pass whole through the driver."""

import re

import pytest
from pyspark.sql import functions as F

from touchline.operators import scans, teams, tracks
from touchline.plans import fixtures
from touchline.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
BY_FRAME = ["b19_foot_zone", "c1_ball_players", "c9_duplicate_pairs", "c9_overlapping_pairs", "c10_new_detections", "d24_mean_histogram", "d29_teams_in_zone", "e1_carrier_hysteresis", "f2_nearest_player", "g2_fit_set", "i5_clip_counters", "i6_prior_corrections"]


@pytest.mark.parametrize("name", BY_FRAME)
def test_frame_joins_are_dealt_by_key(spark, name):
    text = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in text.splitlines() if re.search(r"Join .*frame_idx#", line)]
    assert joins and not any("Broadcast" in line for line in joins)


@pytest.mark.parametrize("name", ["b2_confidence_gate", "b9_crop_gate", "b19_foot_zone", "c1_ball_players", "c2_goalkeepers", "f2_nearest_player"])
def test_players_are_not_the_small_side(spark, name):
    df = QUERIES[name](spark, SF)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    sides = re.findall(r"BroadcastHashJoin \[match_id#\d+\], .*Build(Left|Right)", text)
    assert "Left" not in sides


def test_balls_without_a_join_are_those_of_the_table(spark):
    fx = fixtures.Fixtures(spark, SF)
    own, text = fx.balls, fx.sql(fixtures.TEXT["fx_balls"])
    assert own.schema == text.schema
    assert "Join" not in own._jdf.queryExecution().optimizedPlan().toString()
    assert own.exceptAll(text).isEmpty() and text.exceptAll(own).isEmpty() and own.count() > 0


def test_pixels_are_shuffled_once(spark):
    fx = fixtures.Fixtures(spark, SF)
    text = teams.histogram(fx.pixels)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_features_are_written_before_the_fit(spark):
    rows = spark.createDataFrame([(i, [float(i % 3), float(i % 5), 1.0]) for i in range(30)], "id int, features array<double>")
    done, _ = teams.principal_components(rows, ["id"])
    assert "FileScan parquet" in done._jdf.queryExecution().executedPlan().toString()


def joins_run(df):
    """Joins of the plan that ran."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return re.findall(r"(\w+Join) \[", text)


@pytest.mark.parametrize("name", ["b5_timestamps", "e4_track_gaps"])
def test_bucket_summaries_are_dealt_by_key(spark, name):
    events = spark.read.parquet(f"{SF}/events.parquet")
    mno = events.withColumn("mno", F.floor(F.col("user_id") / 12))
    numbered = scans.number_rows(mno, ["mno"], scans.time_bucket("ts"), ["ts", "event_id"], "frame_idx")
    assert joins_run(numbered if name == "b5_timestamps" else QUERIES[name](spark, SF)) == ["SortMergeJoin"]


@pytest.mark.parametrize("name", ["g3_surviving_tracks", "i13_merged_gallery", "i17_minutes_batch"])
def test_tracks_and_minutes_are_dealt_by_key(spark, name):
    joins = joins_run(QUERIES[name](spark, SF))
    assert joins and "BroadcastHashJoin" not in joins


def test_rounds_of_merged_ids_are_dealt_by_key(spark, monkeypatch):
    plans, durable = [], tracks.durable

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return durable(df, *args)

    monkeypatch.setattr(tracks, "durable", seen)
    pairs = spark.createDataFrame([("m", 1, 2), ("m", 2, 3), ("m", 3, 4), ("n", 7, 9)], "match_id string, a long, b long")
    got = {(r.match_id, r.track_id): r.keep_id for r in tracks.merge_ids(pairs).collect()}
    assert got == {("m", 1): 1, ("m", 2): 1, ("m", 3): 1, ("m", 4): 1, ("n", 7): 7, ("n", 9): 7}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_new_detections_deal_each_box_once(spark):
    text = QUERIES["c10_new_detections"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2 and "Generate explode(sequence" not in text.split("SortMergeJoin")[0]
    boxes = "match_id string, frame_idx long, det_id long, x1 long, y1 long, x2 long, y2 long"
    found = spark.createDataFrame([("m", 0, 1, 0, 0, 10, 10), ("m", 0, 1, 500, 500, 510, 510), ("m", 0, 2, 90, 90, 99, 99), ("m", 0, 2, 90, 90, 99, 99), ("m", 1, 3, 0, 0, 10, 10)], boxes)
    known = spark.createDataFrame([("m", 0, 7, 0, 0, 10, 9), ("m", 0, 8, 95, 95, 300, 300)], boxes)
    got = [(r.frame_idx, r.det_id, r.x1, r.best_iou > 0) for r in tracks.new_detections(found, known).collect()]
    assert sorted(got) == [(0, 2, 90, True), (0, 2, 90, True), (1, 3, 0, False)]
