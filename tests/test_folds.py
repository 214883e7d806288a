"""Folds in pieces equal one serial fold."""

import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import ball, carrier, export, folds, passes
from touchline.operators.rulesets import get_ruleset

RULES = get_ruleset("futsal")
PASS_RULES = [RULES[k] for k in passes.PASS_INPUTS[3:]]


def serial(step, start, rows):
    state, out = start, []
    for at, row in enumerate(rows):
        state, result = step(state, at, row)
        out.append(result)
    return out


def carriers(seed, n):
    rnd, rows, now = random.Random(seed), [], ("oof", None, None)
    for _ in range(n):
        if rnd.random() < 0.35:
            track = rnd.randrange(6)
            now = rnd.choice([("carrier", track, track % 2)] * 3 + [("loose", None, None), ("oof", None, None)])
        rows.append(now)
    return rows


@pytest.mark.parametrize("size, warmup", [(10_000, 0), (37, 0), (37, 20), (8, 8)])
def test_passes_in_pieces(spark, size, warmup):
    frames = {"a": carriers(1, 300), "b": carriers(2, 90)}
    data = [(m, f, *row, *PASS_RULES) for m, rows in frames.items() for f, row in enumerate(rows)]
    random.Random(3).shuffle(data)
    schema = "match_id string, frame_idx bigint, kind string, track_id bigint, team_id int, " + ", ".join(f"{k} int" for k in passes.PASS_INPUTS[3:])
    steps = passes.run_passes(spark.createDataFrame(data, schema).repartition(5), size, warmup)
    got = {(r.match_id, r.frame_idx): tuple(r)[2:] for r in steps.collect()}
    for m, rows in frames.items():
        want = serial(passes.pass_step, passes.PASS_START, [(*r, *PASS_RULES) for r in rows])
        assert [got[m, f] for f in range(len(rows))] == want


@pytest.mark.parametrize("size, warmup", [(10_000, 0), (50, 0), (50, 30)])
def test_ball_in_pieces(spark, size, warmup):
    rnd, x, y, rows = random.Random(5), 100, 200, []
    for _ in range(260):
        x, y = x + rnd.randrange(-9, 12), y + rnd.randrange(-9, 10)
        lost = rnd.random() < 0.25
        jump = 2000 if rnd.random() < 0.05 else 0
        rows.append((None, None, None, 12, 6.0) if lost else (x + jump, y, 0.5, 12, 6.0))
    schema = "match_id string, frame_idx bigint, cx bigint, cy bigint, confidence double, coast int, sigma double"
    frames = spark.createDataFrame([("m", f, *r) for f, r in enumerate(rows)], schema)
    got = {r.frame_idx: tuple(r)[2:] for r in ball.smooth_ball(frames, size, warmup).collect()}
    assert [got[f] for f in range(len(rows))] == serial(ball.ball_step, ball.BALL_START, rows)


@pytest.mark.parametrize("size", [4096, 4])
def test_blocks(spark, size):
    lengths = [60.0] * 4 + [59.5, 300.0] + [70.0] * 9
    rows = spark.createDataFrame([("m", 1, i + 1, s) for i, s in enumerate(lengths)], "match_id string, half int, minute int, clip_duration_seconds double")
    got = [r.block for r in export.assign_blocks(rows, size=size).orderBy("minute").collect()]
    want, filled, block = [], 0.0, 1
    for s in lengths:
        want.append(block)
        filled += s
        if filled >= 280:
            filled, block = 0.0, block + 1
    assert got == want


def test_blocks_of_a_long_half_take_few_rounds(spark, monkeypatch):
    """64 buckets that never agree on a state: the tables written grow with the logarithm of the blocks."""
    rnd, written = random.Random(5), []
    real = export.durable
    monkeypatch.setattr(export, "durable", lambda df, *a: written.append(1) or real(df, *a))
    lengths = [rnd.choice([0.0, 20.25, 60.0, 61.5, 300.0]) for _ in range(640)]
    rows = spark.createDataFrame([("m", 1, i + 1, s) for i, s in enumerate(lengths)], "match_id string, half int, minute int, clip_duration_seconds double")
    got = {r.minute: (r.block, r.block_start) for r in export.assign_blocks(rows, size=10).collect()}
    filled, block, start = 0.0, 1, 0.0
    for i, s in enumerate(lengths):
        assert got[i + 1] == (block, start)
        filled += s
        if filled >= 280:
            filled, block, start = 0.0, block + 1, start + filled
    assert len(written) <= 10


@pytest.mark.parametrize("size", [4096, 5])
def test_hysteresis_over_buckets(spark, size):
    rows = carriers(9, 120)
    df = spark.createDataFrame([("m", f, *r) for f, r in enumerate(rows)], "match_id string, frame_idx bigint, kind string, track_id bigint, team_id int")
    got = {r.frame_idx: (r.kind, r.track_id, r.team_id) for r in carrier.commit_carrier(df, 3, size).collect()}
    held = ("oof", None, None)
    for f, row in enumerate(rows):
        last = rows[max(0, f - 2): f + 1]
        if len(last) == 3 and all(r[:2] == row[:2] for r in last):
            held = row
        assert got[f] == held


def test_area_growth(spark):
    areas = [10, 25, 100, 60, 10, 40]
    df = spark.createDataFrame([("m", 1, f, 0, 0, a, 1) for f, a in enumerate(areas)], "match_id string, track_id int, frame_idx bigint, x1 int, y1 int, x2 int, y2 int")
    got = [r.accepted for r in ball.plausible_boxes(df, F.lit(400.0)).orderBy("frame_idx").collect()]
    # 100 exceeds the share of the frame, 40 grows from 10 more than three times
    assert got == [True, True, False, True, True, False]


def test_pieces_of_several_keys_in_one_partition(spark):
    def count(state, _at, _row):
        return (state[0] + 1,), (state[0] + 1,)

    boxes = spark.createDataFrame([("m", t, f, 1.0) for t in (1, 2, 3) for f in range(40)], "match_id string, track_id bigint, frame_idx bigint, area double")
    done = folds.fold(boxes, ["match_id", "track_id"], "frame_idx", ["area"], count, (0,), "n int", size=8, warmup=0)
    assert {(r.track_id, r.frame_idx): r.n for r in done.collect()} == {(t, f): f + 1 for t in (1, 2, 3) for f in range(40)}


def test_a_partition_is_streamed(spark, monkeypatch):
    # one call for each piece cost more than its rows, and a call held its whole piece
    def whole_groups(*_):
        raise AssertionError("a group is handed over whole")

    monkeypatch.setattr("pyspark.sql.group.GroupedData.applyInPandas", whole_groups)
    boxes = spark.createDataFrame([("m", 1, f, 0, 0, 9, 9) for f in range(30)], "match_id string, track_id bigint, frame_idx bigint, x1 int, y1 int, x2 int, y2 int")
    assert ball.plausible_boxes(boxes, F.lit(1000.0), 8).filter("accepted").count() == 30


def test_repaired_pieces_stay_whole(spark, monkeypatch):
    """The join that finds wrong pieces is planned as a merge join and runs as a broadcast, which reads rows where their files are."""
    real = folds.durable

    def whole(df, name="table", *args):
        table = real(df, name, *args)
        if name == "fold" and args:
            edges = table.filter("_edge").select("match_id", "_bucket")
            assert edges.count() == edges.distinct().count()
        return table

    monkeypatch.setattr(folds, "durable", whole)
    settings = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "10k", "adaptive.coalescePartitions.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(f"spark.sql.{name}", value)
    try:
        test_passes_in_pieces(spark, 37, 0)
    finally:
        for name in settings:
            spark.conf.unset(f"spark.sql.{name}")


def test_rounds_of_a_long_chain(spark, monkeypatch):
    """64 pieces that never enter with the right state: the rounds grow with the logarithm of the pieces."""
    def count(state, _at, _row):
        return (state[0] + 1,), (state[0] + 1,)

    written, real = [], folds.durable
    monkeypatch.setattr(folds, "durable", lambda df, *a: written.append(a) or real(df, *a))
    boxes = spark.createDataFrame([("m", f, 1.0) for f in range(256) if not 40 <= f < 48], "match_id string, frame_idx long, area double")
    done = folds.fold(boxes, ["match_id"], "frame_idx", ["area"], count, (0,), "n int", size=4, warmup=2)
    assert {r.frame_idx: r.n for r in done.collect()} == {f: f + 1 if f < 40 else f - 7 for f in range(256) if not 40 <= f < 48}
    assert sum(a[0] == "fold" for a in written) <= 3
