"""Hand-made sequences through the pass machine and the clip accounting."""

import random

import pytest

from touchline.functions.counters import COUNTERS
from touchline.operators import passes as ps
from touchline.operators.rulesets import get_ruleset
from touchline.streaming.session_steps import move_frames

RULES = [1, 2, 1, 22]
A, A2, B = ("carrier", 1, 0), ("carrier", 3, 0), ("carrier", 2, 1)
LOOSE, OOF = ("loose", None, None), ("oof", None, None)


def run(rows, rules=RULES):
    state, out = ps.PASS_START, []
    for f, row in enumerate(rows):
        state, result = ps.pass_step(state, f, (*row, *rules))
        out.append(dict(zip([c.split()[0] for c in ps.PASS_OUTPUT.split(", ")], result)))
    return out


def test_completed_pass():
    out = run([A] * 3 + [LOOSE] * 3 + [A2] * 4)
    events = [(f, r["event"], r["from_track"], r["to_track"], r["travel_frames"]) for f, r in enumerate(out) if r["event"]]
    assert events == [(8, "completed", 1, 3, 5)]
    assert {r["label"] for r in out} == {"team_a"} and not any(r["adj_kind"] for r in out)


def test_interception_flips_credit():
    out = run([A] * 2 + [LOOSE] * 2 + [B] * 4)
    hit = next(r for r in out if r["event"])
    assert (hit["event"], hit["adj_kind"], hit["adj_team"], hit["adj_n"]) == ("interception", "flip_to", 1, 4)
    assert out[-1]["label"] == "team_b"


def test_ball_lost_drops_credit_and_is_oof():
    out = run([A] + [LOOSE] * 24 + [B, B])
    hit = next(f for f, r in enumerate(out) if r["event"])
    assert (out[hit]["event"], out[hit]["adj_kind"], out[hit]["adj_team"]) == ("ball_lost", "drop", 0)
    assert out[hit]["label"] == "oof" and out[hit]["phase"] == ps.IDLE
    assert out[hit + 1]["phase"] == ps.HOLDING


def test_return_to_passer_is_no_event():
    out = run([A] * 2 + [LOOSE] * 3 + [A] * 3)
    assert not any(r["event"] for r in out) and out[-1]["phase"] == ps.HOLDING and out[-1]["travel"] == 0


def test_passer_regains_one_frame_after_a_dropped_catch():
    out = run([A, LOOSE, LOOSE, B, A, A])
    assert [r["phase"] for r in out[2:]] == [ps.TRAVEL, ps.CATCHING, ps.TRAVEL, ps.HOLDING]


def test_timeout_is_not_tested_while_catching():
    out = run([A] + [LOOSE] * 23 + [B, B, B])
    assert [r["event"] for r in out if r["event"]] == ["interception"]


def test_team_of_the_passer_is_frozen():
    out = run([A, ("carrier", 1, 1), ("carrier", 1, 1)])
    assert {r["label"] for r in out} == {"team_a"}


@pytest.mark.parametrize(
    "a, b, oof, kind, team, n, want",
    [(10, 5, 0, "flip_to", 1, 4, (6, 9, 0)), (2, 0, 0, "flip_to", 1, 10, (0, 2, 0)), (10, 0, 1, "drop", 0, 3, (7, 0, 4)), (0, 2, 0, "drop", 1, 10, (0, 0, 2)), (4, 4, 0, "drop", 0, 0, (4, 4, 0))],
)
def test_clamped_adjustment(spark, a, b, oof, kind, team, n, want):
    from pyspark.sql import functions as F

    from touchline.functions.counters import adjust

    got = spark.range(1).select(adjust(*[F.lit(v) for v in (kind, team, n, a, b, oof)]).alias("r")).first().r
    assert (got.a, got.b, got.oof) == want
    counts = dict.fromkeys(COUNTERS, 0) | {"frames_team_a": a, "frames_team_b": b, "frames_oof": oof}
    move_frames(counts, kind, team, n)
    assert (counts["frames_team_a"], counts["frames_team_b"], counts["frames_oof"]) == want


def test_carryover(spark):
    """A pass over the boundary: the part before it becomes a correction."""
    rows = [A] * 8 + [LOOSE] * 4 + [B] * 8
    data = [("m", f, 1, 1 if f < 10 else 2, *r, *RULES) for f, r in enumerate(rows)]
    schema = "match_id string, frame_idx bigint, half int, minute int, kind string, track_id bigint, team_id int, " + ", ".join(f"{k} int" for k in ps.PASS_INPUTS[3:])
    df = spark.createDataFrame(data, schema)
    steps = ps.run_passes(df).join(df.select("match_id", "frame_idx", "half", "minute"), ["match_id", "frame_idx"])
    first, second = ps.minute_rows(steps).orderBy("minute").collect()
    # frames 8 to 13 travel; frames 8 and 9 belong to minute 1
    assert (first.frames_team_a, first.corr_kind) == (10, None)
    assert (second.frames_team_a, second.frames_team_b, second.interceptions_team_a) == (0, 10, 1)
    assert (second.corr_half, second.corr_minute, second.corr_kind, second.corr_team, second.corr_frames) == (1, 1, "flip_to", 1, 2)
    clusters = df.select("match_id", "half", "minute").distinct().selectExpr("*", "CAST(NULL AS INT) AS team_a_cluster_id")
    final = ps.final_minutes(ps.minute_rows(steps), clusters).orderBy("minute").collect()
    assert [(r.frames_team_a, r.frames_team_b, r.revision) for r in final] == [(8, 2, 1), (0, 10, 0)]


def test_late_adjustment_uses_stale_carry_unless_strict(spark):
    """A spanning pass that completes leaves its carry to the next adjustment."""
    rows = [A] * 8 + [LOOSE] * 4 + [A2] * 5 + [LOOSE] * 3 + [B] * 8
    data = [("m", f, 1, 1 if f < 10 else 2, *r, *RULES) for f, r in enumerate(rows)]
    schema = "match_id string, frame_idx bigint, half int, minute int, kind string, track_id bigint, team_id int, " + ", ".join(f"{k} int" for k in ps.PASS_INPUTS[3:])
    df = spark.createDataFrame(data, schema)
    steps = ps.run_passes(df).join(df.select("match_id", "frame_idx", "half", "minute"), ["match_id", "frame_idx"])
    kept = ps.minute_rows(steps).filter("minute = 2").first()
    strict = ps.minute_rows(steps, strict_carryover=True).filter("minute = 2").first()
    assert kept.corr_frames == 2 and strict.corr_frames is None
    assert kept.frames_team_b == strict.frames_team_b - 2


def test_rulesets():
    assert get_ruleset("classic")["travel_timeout_frames"] == 45
    with pytest.raises(ValueError):
        get_ruleset("beach")


def serial_unit(rows):
    a = b = loose = oof = 0
    for _, _, label, _, _, kind, team, n in rows:
        a, b, loose, oof = a + (label == "team_a"), b + (label == "team_b"), loose + (label == "loose"), oof + (label == "oof")
        if kind == "flip_to":
            move = min(n, b if team == 0 else a)
            a, b = (a + move, b - move) if team == 0 else (a - move, b + move)
        elif kind == "drop":
            move = min(n, a if team == 0 else b)
            a, b, oof = a - move * (team == 0), b - move * (team == 1), oof + move
    return a, b, loose, oof


@pytest.mark.parametrize("size", [16384, 16, 3])
def test_a_whole_match_is_one_unit(spark, size):
    """Adjustments often ask for more than there is, in several buckets, so later starts depend on earlier clamps."""
    rnd, rows = random.Random(size), []
    for match in ("m", "n", "quiet"):
        for f in range(200):
            kind = None if match == "quiet" else rnd.choice([None, None, "flip_to", "drop"])
            label = rnd.choice(["team_a", "team_b", "loose", "oof", "oof"])
            rows.append((match, f, label, None, None, kind, kind and rnd.randrange(2), kind and rnd.randrange(1, 40)))
    schema = "match_id string, frame_idx long, label string, event string, from_team int, adj_kind string, adj_team int, adj_n int"
    got = {r["match_id"]: (r["frames_team_a"], r["frames_team_b"], r["frames_loose"], r["frames_oof"]) for r in ps.whole_match(spark.createDataFrame(rows, schema), size).collect()}
    assert got == {m: serial_unit([r for r in rows if r[0] == m]) for m in ("m", "n", "quiet")}


def test_a_whole_match_differs_from_its_minutes(spark):
    """The pass over the boundary flips 4 frames: as one unit all of them, by minutes the two of its own and a correction."""
    labels = ["team_b"] * 3 + ["team_a"] * 2 + ["team_a"] * 4
    phases = ["in_possession"] * 3 + ["travel"] * 5 + ["in_possession"]
    rows = [("m", f, 1, 1 + (f >= 5), lab, ph, 0, None, None, None, None, None) for f, (lab, ph) in enumerate(zip(labels, phases))]
    rows[4] = (*rows[4][:6], 2, *rows[4][7:])
    rows[8] = ("m", 8, 1, 2, "team_a", "in_possession", 0, "interception", 0, "flip_to", 1, 8)
    schema = "match_id string, frame_idx long, half int, minute int, label string, phase string, travel int, event string, from_team int, adj_kind string, adj_team int, adj_n int"
    df = spark.createDataFrame(rows, schema)
    unit = ps.whole_match(df).first()
    minutes = ps.minute_rows(df).agg({"frames_team_a": "sum", "frames_team_b": "sum"}).first()
    assert (unit["frames_team_a"], unit["frames_team_b"]) == (0, 9) and minutes["sum(frames_team_a)"] == 2
