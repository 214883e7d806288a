"""Folds and frame scans over several pieces of every match, against the SQL of the queries with large pieces."""

from pyspark.sql import functions as F

from touchline.functions import counters as cnt
from touchline.operators import ball, carrier, ingest, passes as ps, tracks as tk
from touchline.operators.joins import dealt
from touchline.plans import detection_queries as dq, live_queries as lq, pass_queries as pq, track_queries as tq
from touchline.plans.registry import query

# frames of a piece, well below those of a match in the smallest tables, and of its warm-up
PIECE, WARMUP = 128, 48


def steps(fx):
    held = carrier.commit_carrier(fx.carrier.drop("mno"), 3, PIECE)
    return ps.run_passes(held.withColumns({k: F.lit(v) for k, v in pq.SETTINGS.items()}), PIECE, WARMUP)


@query("e1_carrier_hysteresis_pieces", like="e1_carrier_hysteresis")
def e1(fx):
    """E1 in pieces."""
    return carrier.commit_carrier(dq.raw(fx), 3, PIECE).select("match_id", "frame_idx", "kind", "track_id", "team_id")


@query("i1_ball_filter_pieces", like="i1_ball_filter")
def i1(fx):
    """I1 in pieces."""
    return ball.smooth_ball(pq.ball_frames(fx), PIECE, WARMUP)


@query("i3_possession_labels_pieces", like="i3_possession_labels")
def i3(fx):
    """I2, I3 in pieces."""
    return steps(fx).select("match_id", "frame_idx", "label", "phase")


@query("e8_phase_log_pieces", like="e8_phase_log")
def e8(fx):
    """E8 in pieces."""
    return ps.transitions(steps(fx), PIECE)


@query("i5_clip_counters_pieces", like="i5_clip_counters")
def i5(fx):
    """I5 in pieces."""
    placed = steps(fx).join(dealt(fx.frames.select("match_id", "frame_idx", "half", "minute")), ["match_id", "frame_idx"])
    return ps.minute_rows(placed).select("match_id", "half", "minute", *cnt.COUNTERS[:4])


@query("i14_area_plausibility_pieces", like="i14_area_plausibility")
def i14(fx):
    """I14 in pieces."""
    return ball.plausible_boxes(pq.widened(fx), F.lit(150000.0), PIECE)


@query("i17_minutes_batch_pieces", like="i17_minutes_batch")
def i17(fx):
    """I17 in pieces."""
    return lq.corrected(lq.chain(fx, PIECE, WARMUP))


@query("d13_running_team_pieces", like="d13_running_team")
def d13(fx):
    """D13 in pieces."""
    return tk.running_team(fx.sql(tq.VOTES), PIECE).select("match_id", "track_id", "frame_idx", "team_so_far")


@query("e9_metadata_evolution_pieces", like="e9_metadata_evolution")
def e9(fx):
    """E9 in pieces."""
    return ingest.evolve_metadata(fx.requests.filter("request = 'clip'"), 16)
