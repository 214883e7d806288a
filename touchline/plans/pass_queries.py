"""Ball filter, pass machine and the minutes built from them."""

from pyspark.sql import functions as F

from touchline.functions import counters as cnt
from touchline.operators import ball, carrier, detections as det, passes as ps
from touchline.operators.joins import dealt
from touchline.plans.detection_queries import COMMIT, RULES, ruled
from touchline.plans.registry import query

SETTINGS = {"release_sustain": 1, "reception_settle": 2, "travel_min_gap": 1, "travel_timeout_frames": 22}


def carriers(fx):
    """Committed carriers with the pass settings of one ruleset."""
    held = carrier.commit_carrier(fx.carrier.drop("mno"), 3)
    return held.withColumns({k: F.lit(v) for k, v in SETTINGS.items()})


def steps(fx):
    return ps.run_passes(carriers(fx))


def clip_steps(fx):
    return steps(fx).join(dealt(fx.frames.select("match_id", "frame_idx", "half", "minute")), ["match_id", "frame_idx"])


# the same machine as one recursive query, with the counters of the running clip
FSM = COMMIT.format(raw="fx_carrier") + """,
fsm AS (SELECT match_id, CAST(-1 AS BIGINT) AS f, 'idle' AS phase, CAST(NULL AS BIGINT) AS g, CAST(NULL AS INT) AS gt, CAST(NULL AS BIGINT) AS r, CAST(NULL AS INT) AS rt,
  CAST(-1 AS BIGINT) AS la, CAST(-1 AS BIGINT) AS ra, CAST(-1 AS BIGINT) AS ca, CAST(0 AS INT) AS n, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS move,
  CAST(NULL AS BIGINT) AS og, CAST(NULL AS INT) AS ogt, CAST(NULL AS BIGINT) AS orr, CAST(NULL AS INT) AS ort, CAST(NULL AS BIGINT) AS ora, CAST(NULL AS INT) AS onn,
  CAST(NULL AS INT) AS half, CAST(NULL AS INT) AS minute FROM (SELECT DISTINCT match_id FROM fx_carrier) m
UNION ALL
SELECT match_id, f, CASE move WHEN 'take' THEN 'in_possession' WHEN 'return' THEN 'in_possession' WHEN 'resolve' THEN 'in_possession' WHEN 'leave' THEN 'candidate_release'
   WHEN 'release' THEN 'travel' WHEN 'drop' THEN 'travel' WHEN 'catch' THEN 'candidate_reception' WHEN 'lose' THEN 'idle' ELSE phase END AS phase,
  CASE move WHEN 'take' THEN t WHEN 'resolve' THEN r WHEN 'lose' THEN NULL ELSE g END AS g, CASE move WHEN 'take' THEN tt WHEN 'resolve' THEN rt WHEN 'lose' THEN NULL ELSE gt END AS gt,
  CASE move WHEN 'catch' THEN t WHEN 'stay' THEN r ELSE NULL END AS r, CASE move WHEN 'catch' THEN tt WHEN 'stay' THEN rt ELSE NULL END AS rt,
  CASE WHEN move IN ('take', 'return', 'resolve', 'lose') THEN -1 WHEN move = 'leave' THEN f ELSE la END AS la,
  CASE WHEN move IN ('take', 'return', 'resolve', 'lose') THEN -1 WHEN move = 'release' THEN f ELSE ra END AS ra,
  CASE WHEN move IN ('take', 'return', 'resolve', 'lose') THEN -1 WHEN move = 'catch' THEN f ELSE ca END AS ca,
  CAST(CASE WHEN move IN ('take', 'return', 'resolve', 'lose') THEN 0 WHEN move = 'leave' THEN 1 WHEN phase IN ('in_possession', 'idle') THEN n ELSE n + 1 END AS INT) AS n,
  kind, move, g, gt, r, rt, ra, n, half, minute
FROM (SELECT *, CASE WHEN phase = 'idle' THEN CASE WHEN car THEN 'take' ELSE 'stay' END
   WHEN phase = 'in_possession' THEN CASE WHEN car AND t = g THEN 'stay' ELSE 'leave' END
   WHEN phase = 'candidate_release' THEN CASE WHEN car AND t = g THEN 'return' WHEN f - la >= 1 THEN 'release' ELSE 'stay' END
   WHEN phase = 'travel' THEN CASE WHEN f - ra > 22 THEN 'lose' WHEN car AND t = g THEN 'return' WHEN car AND f - ra >= 1 THEN 'catch' ELSE 'stay' END
   ELSE CASE WHEN car AND t = r AND f - ca >= 2 THEN 'resolve' WHEN car AND t = r THEN 'stay' WHEN car AND t <> g AND f - ra >= 1 THEN 'catch' ELSE 'drop' END END AS move
  FROM (SELECT s.match_id, c.frame_idx AS f, s.phase, s.g, s.gt, s.r, s.rt, s.la, s.ra, s.ca, s.n, c.kind, c.kind = 'carrier' AS car, c.track_id AS t, c.team_id AS tt, c.half, c.minute
    FROM fsm s JOIN committed c ON c.match_id = s.match_id AND c.frame_idx = s.f + 1) j) m),
frames AS MATERIALIZED (SELECT match_id, f AS frame_idx, half, minute, phase, g, gt, r, rt, n, move,
  CASE WHEN phase = 'idle' THEN CASE WHEN kind = 'loose' THEN 'loose' ELSE 'oof' END WHEN gt = 0 THEN 'team_a' ELSE 'team_b' END AS label,
  CASE WHEN move = 'lose' THEN 'ball_lost' WHEN move = 'resolve' THEN CASE WHEN ogt = ort THEN 'completed' ELSE 'interception' END END AS event,
  og AS from_track, ogt AS from_team, CASE WHEN move = 'resolve' THEN orr END AS to_track, CASE WHEN move = 'resolve' THEN ort END AS to_team, ora AS release_frame, onn AS travel_frames,
  lag(phase) OVER (PARTITION BY match_id ORDER BY f) AS was FROM fsm WHERE f >= 0),
fixes AS MATERIALIZED (SELECT match_id, frame_idx, half, minute, CASE event WHEN 'ball_lost' THEN 'drop' ELSE 'flip_to' END AS kind, CASE event WHEN 'ball_lost' THEN from_team ELSE to_team END AS team_id, travel_frames AS n
  FROM frames WHERE event IN ('ball_lost', 'interception') AND travel_frames > 0)
"""
# clip accounting, one frame at a time
ACCOUNT = FSM + """,
walk AS (SELECT match_id, CAST(-1 AS BIGINT) AS f, CAST(NULL AS INT) AS half, CAST(NULL AS INT) AS minute, 0 AS a, 0 AS b, 0 AS l, 0 AS o, 0 AS carry, CAST(NULL AS INT) AS ph, CAST(NULL AS INT) AS pm,
  CAST(NULL AS VARCHAR) AS ck, CAST(NULL AS INT) AS ct, CAST(NULL AS INT) AS cn, 0 AS tail FROM (SELECT DISTINCT match_id FROM fx_carrier) m
UNION ALL
SELECT match_id, f, half, minute,
  CAST(a + CASE WHEN k = 'flip_to' AND t = 0 THEN least(cur, b) WHEN k = 'flip_to' OR (k = 'drop' AND t = 0) THEN -least(cur, a) ELSE 0 END AS INT) AS a,
  CAST(b + CASE WHEN k = 'flip_to' AND t = 1 THEN least(cur, a) WHEN k = 'flip_to' OR (k = 'drop' AND t = 1) THEN -least(cur, b) ELSE 0 END AS INT) AS b, l,
  CAST(o + CASE WHEN k = 'drop' AND t = 0 THEN least(cur, a) WHEN k = 'drop' THEN least(cur, b) ELSE 0 END AS INT) AS o,
  CAST(carry - prior AS INT) AS carry, ph, pm, CASE WHEN ck IS NULL AND prior > 0 AND ph IS NOT NULL THEN k ELSE ck END AS ck, CASE WHEN ck IS NULL AND prior > 0 AND ph IS NOT NULL THEN t ELSE ct END AS ct,
  CAST(CASE WHEN ck IS NULL AND prior > 0 AND ph IS NOT NULL THEN prior ELSE cn END AS INT) AS cn, tail
FROM (SELECT *, CASE WHEN n IS NULL THEN 0 ELSE least(n, carry) END AS prior, n - least(n, carry) AS cur FROM (
  SELECT w.match_id, x.frame_idx AS f, x.half, x.minute, fx.kind AS k, fx.team_id AS t, fx.n,
   CASE WHEN same THEN w.a ELSE 0 END + CASE WHEN x.label = 'team_a' THEN 1 ELSE 0 END AS a, CASE WHEN same THEN w.b ELSE 0 END + CASE WHEN x.label = 'team_b' THEN 1 ELSE 0 END AS b,
   CASE WHEN same THEN w.l ELSE 0 END + CASE WHEN x.label = 'loose' THEN 1 ELSE 0 END AS l, CASE WHEN same THEN w.o ELSE 0 END + CASE WHEN x.label = 'oof' THEN 1 ELSE 0 END AS o,
   CASE WHEN same THEN w.carry ELSE w.tail END AS carry, CASE WHEN same THEN w.ph ELSE w.half END AS ph, CASE WHEN same THEN w.pm ELSE w.minute END AS pm,
   CASE WHEN same THEN w.ck END AS ck, CASE WHEN same THEN w.ct END AS ct, CASE WHEN same THEN w.cn END AS cn,
   CASE WHEN x.phase IN ('candidate_release', 'travel', 'candidate_reception') THEN x.n ELSE 0 END AS tail
  FROM (SELECT w.*, y.half = w.half AND y.minute = w.minute AS same0 FROM walk w JOIN frames y ON y.match_id = w.match_id AND y.frame_idx = w.f + 1) w
  JOIN frames x ON x.match_id = w.match_id AND x.frame_idx = w.f + 1 CROSS JOIN LATERAL (SELECT coalesce(w.same0, false) AS same) s
  LEFT JOIN fixes fx ON fx.match_id = x.match_id AND fx.frame_idx = x.frame_idx) z) q),
ends AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, half, minute ORDER BY f DESC) AS rn FROM walk WHERE f >= 0) e WHERE rn = 1)
"""


@query("i2_pass_events", "WITH " + FSM + "SELECT match_id, event AS kind, from_track, from_team, to_track, to_team, release_frame, frame_idx AS end_frame, travel_frames FROM frames WHERE event IS NOT NULL")
def i2(fx):
    """Completed passes, interceptions and lost balls."""
    return ps.pass_events(steps(fx))


@query("i3_possession_labels", "WITH " + FSM + "SELECT match_id, frame_idx, label, phase FROM frames")
def i3(fx):
    """Possession label and phase of every frame."""
    return steps(fx).select("match_id", "frame_idx", "label", "phase")


@query("i4_adjustments", "WITH " + FSM + "SELECT match_id, frame_idx, kind, CAST(team_id AS INT) AS team_id, n AS frames FROM fixes")
def i4(fx):
    """I4: credit changed afterwards."""
    return ps.adjustments(steps(fx))


@query("e8_phase_log", "WITH " + FSM + """, t AS (SELECT *, CASE WHEN phase = 'in_possession' AND coalesce(was, 'idle') = 'idle' THEN 'NEW CARRIER' WHEN phase = 'candidate_release' THEN 'CAND RELEASE'
 WHEN phase = 'travel' AND was = 'candidate_release' THEN 'RELEASE CONFIRMED' WHEN phase = 'candidate_reception' THEN 'CAND RECEPTION' WHEN phase = 'travel' AND was = 'candidate_reception' THEN 'RECEPTION DROPPED' END AS message
 FROM frames WHERE phase <> coalesce(was, 'idle')) SELECT match_id, frame_idx, message, g AS giver, gt AS giver_team, r AS taker, rt AS taker_team FROM t WHERE message IS NOT NULL""")
def e8(fx):
    """Log of phase changes."""
    return ps.transitions(steps(fx))


@query("c3_events_to_clips", "WITH " + FSM + "SELECT match_id, frame_idx AS end_frame, event AS kind, half, minute FROM frames WHERE event IS NOT NULL")
def c3(fx):
    """Events assigned to the clip in which they resolve, by frame range."""
    clips = fx.frames.groupBy("match_id", "half", "minute").agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"))
    return ps.assign_clips(ps.pass_events(steps(fx)), clips).select("match_id", "end_frame", "kind", "half", "minute")


@query("i5_clip_counters", "WITH " + ACCOUNT + "SELECT match_id, half, minute, a AS frames_team_a, b AS frames_team_b, CAST(l AS INT) AS frames_loose, o AS frames_oof FROM ends")
def i5(fx):
    """Frames per clip with state carried over clip boundaries."""
    return ps.minute_rows(clip_steps(fx)).select("match_id", "half", "minute", *cnt.COUNTERS[:4])


@query("i6_prior_corrections", "WITH " + ACCOUNT + "SELECT match_id, ph AS half, pm AS minute, ck AS kind, ct AS team_id, cn AS frames FROM ends WHERE ck IS NOT NULL")
def i6(fx):
    """Corrections of the minute before, one per clip at most."""
    return ps.corrections(ps.minute_rows(clip_steps(fx)))


WHOLE = FSM + """,
unit AS (SELECT match_id, CAST(-1 AS BIGINT) AS f, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS l, CAST(0 AS BIGINT) AS o FROM (SELECT DISTINCT match_id FROM fx_carrier) m
UNION ALL SELECT match_id, f, a + CASE WHEN k = 'flip_to' AND t = 0 THEN least(n, b) WHEN k = 'flip_to' OR (k = 'drop' AND t = 0) THEN -least(n, a) ELSE 0 END,
  b + CASE WHEN k = 'flip_to' AND t = 1 THEN least(n, a) WHEN k = 'flip_to' OR (k = 'drop' AND t = 1) THEN -least(n, b) ELSE 0 END, l,
  o + CASE WHEN k = 'drop' AND t = 0 THEN least(n, a) WHEN k = 'drop' THEN least(n, b) ELSE 0 END
 FROM (SELECT u.match_id, x.frame_idx AS f, u.a + CASE WHEN x.label = 'team_a' THEN 1 ELSE 0 END AS a, u.b + CASE WHEN x.label = 'team_b' THEN 1 ELSE 0 END AS b, u.l + CASE WHEN x.label = 'loose' THEN 1 ELSE 0 END AS l,
   u.o + CASE WHEN x.label = 'oof' THEN 1 ELSE 0 END AS o, fx.kind AS k, fx.team_id AS t, fx.n FROM unit u JOIN frames x ON x.match_id = u.match_id AND x.frame_idx = u.f + 1
   LEFT JOIN fixes fx ON fx.match_id = x.match_id AND fx.frame_idx = x.frame_idx) z),
counts AS (SELECT match_id, """ + ", ".join(f"count(*) FILTER (event = '{e}' AND from_team = {t}) AS {n}_team_{s}" for e, n in (("completed", "passes_completed"), ("interception", "interceptions"), ("ball_lost", "ball_lost")) for t, s in ((0, "a"), (1, "b"))) + """ FROM frames GROUP BY match_id)
SELECT u.match_id, CAST(1 AS INT) AS half, CAST(1 AS INT) AS minute, 0e0 AS clip_duration_seconds, a AS frames_team_a, b AS frames_team_b, l AS frames_loose, o AS frames_oof, c.* EXCLUDE (match_id)
FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY f DESC) AS rn FROM unit WHERE f >= 0) u JOIN counts c ON c.match_id = u.match_id WHERE rn = 1"""


@query("d32_one_unit", "WITH " + WHOLE)
def d32_unit(fx):
    """Whole matches as one unit, without clip boundaries."""
    return ps.whole_match(steps(fx))


@query("d32_one_unit_pieces", like="d32_one_unit")
def d32_unit_pieces(fx):
    """The same in buckets of 128 frames."""
    return ps.whole_match(steps(fx), size=128)


KALMAN = RULES + """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame_idx ORDER BY confidence DESC, ball_no) AS rn FROM fx_balls) b WHERE rn = 1),
obs AS (SELECT f.match_id, f.frame_idx, b.cx, b.cy, b.confidence, r.coast, r.sigma FROM fx_frames f LEFT JOIN best b ON b.match_id = f.match_id AND b.frame_idx = f.frame_idx
  JOIN fx_matches m ON m.match_id = f.match_id JOIN fx_rules r ON r.ruleset = m.ruleset),
ball AS (SELECT match_id, CAST(-1 AS BIGINT) AS f, false AS seen, 0e0 AS x, 0e0 AS vx, 0e0 AS y, 0e0 AS vy, 0e0 AS p, 0e0 AS c, 0e0 AS v, 0 AS missing, CAST(NULL AS VARCHAR) AS st, 0e0 AS conf
  FROM (SELECT DISTINCT match_id FROM fx_frames) m
UNION ALL
SELECT match_id, f, seen OR mx IS NOT NULL, CASE WHEN hit THEN x + (p / s) * (mx - x) WHEN seen THEN x WHEN mx IS NOT NULL THEN mx ELSE x END, CASE WHEN hit THEN vx + (c / s) * (mx - x) ELSE vx END,
  CASE WHEN hit THEN y + (p / s) * (my - y) WHEN seen THEN y WHEN mx IS NOT NULL THEN my ELSE y END, CASE WHEN hit THEN vy + (c / s) * (my - y) ELSE vy END,
  CASE WHEN hit THEN (1e0 - p / s) * p WHEN seen THEN p WHEN mx IS NOT NULL THEN 100e0 ELSE p END, CASE WHEN hit THEN (1e0 - p / s) * c ELSE c END,
  CASE WHEN hit THEN v - (c / s) * c WHEN seen THEN v WHEN mx IS NOT NULL THEN 100e0 ELSE v END,
  CASE WHEN hit OR NOT seen THEN 0 ELSE missing + 1 END, CASE WHEN hit OR (NOT seen AND mx IS NOT NULL) THEN 'detected' WHEN seen AND missing + 1 <= coast THEN 'coasting' ELSE 'lost' END,
  CASE WHEN hit OR (NOT seen AND mx IS NOT NULL) THEN mconf ELSE 0e0 END
FROM (SELECT *, coalesce(seen AND mx IS NOT NULL AND ((mx - x) * (mx - x) + (my - y) * (my - y)) / s <= sigma * sigma, false) AS hit FROM (SELECT *, p + 9e0 AS s FROM (
  SELECT b.match_id, o.frame_idx AS f, b.seen, CASE WHEN b.seen THEN b.x + b.vx ELSE b.x END AS x, b.vx, CASE WHEN b.seen THEN b.y + b.vy ELSE b.y END AS y, b.vy,
   CASE WHEN b.seen THEN b.p + 2e0 * b.c + b.v + 4e0 ELSE b.p END AS p, CASE WHEN b.seen THEN b.c + b.v ELSE b.c END AS c, CASE WHEN b.seen THEN b.v + 25e0 ELSE b.v END AS v,
   b.missing, CAST(o.cx AS DOUBLE) AS mx, CAST(o.cy AS DOUBLE) AS my, o.confidence AS mconf, o.coast, o.sigma
  FROM ball b JOIN obs o ON o.match_id = b.match_id AND o.frame_idx = b.f + 1) i) j) k)
"""


def ball_frames(fx):
    rules = ruled(fx, fx.frames.select("match_id", "frame_idx"), "kalman_coast_frames", "kalman_gate_sigma")
    rules = rules.withColumnsRenamed({"kalman_coast_frames": "coast", "kalman_gate_sigma": "sigma"})
    return rules.join(dealt(det.best_ball(fx.balls)), ["match_id", "frame_idx"], "left")


@query("i1_ball_filter", "WITH " + KALMAN + """SELECT match_id, f AS frame_idx, st AS ball_state, CASE WHEN st <> 'lost' THEN CAST(trunc(x) AS BIGINT) END AS bx, CASE WHEN st <> 'lost' THEN CAST(trunc(y) AS BIGINT) END AS by,
 CASE WHEN st <> 'lost' THEN conf END AS ball_conf FROM ball WHERE f >= 0""")
def i1(fx):
    """Smoothed ball of every frame."""
    return ball.smooth_ball(ball_frames(fx))


HELD = KALMAN + """, boxed AS (SELECT k.match_id, k.f AS frame_idx, k.st, CASE WHEN k.st = 'detected' THEN b.cx - 8 END AS x, CASE WHEN k.st = 'detected' THEN b.cy + 9 END AS y FROM ball k LEFT JOIN best b ON b.match_id = k.match_id AND b.frame_idx = k.f WHERE k.f >= 0),
held AS (SELECT *, last_value(x IGNORE NULLS) OVER w AS hx, last_value(y IGNORE NULLS) OVER w AS hy FROM boxed WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING))
SELECT match_id, frame_idx, st AS ball_state, CASE WHEN st <> 'lost' THEN hx END AS x1, CASE WHEN st <> 'lost' THEN hy END AS y2 FROM held"""


@query("i1_held_box", "WITH " + HELD)
def i1_held(fx):
    """Box of the ball in every frame, kept while it coasts."""
    boxes = det.best_ball(fx.balls).select("match_id", "frame_idx", (F.col("cx") - 8).alias("x1"), (F.col("cy") - 8).alias("y1"), (F.col("cx") + 9).alias("x2"), (F.col("cy") + 9).alias("y2"))
    return ball.held_boxes(ball.smooth_ball(ball_frames(fx)), boxes).select("match_id", "frame_idx", "ball_state", "x1", "y2")


AREAS = """areas AS (SELECT match_id, track_id, frame_idx, (x2 - x1) * (y2 - y1) * (1 + (x1 + y1) % 5) * (1 + x1 % 3) + 0e0 AS area, row_number() OVER (PARTITION BY match_id, track_id ORDER BY frame_idx) AS rn FROM fx_players),
keep AS (SELECT match_id, track_id, frame_idx, rn, area <= 3e4 AS ok, CASE WHEN area <= 3e4 THEN area ELSE 0e0 END AS last FROM areas WHERE rn = 1
 UNION ALL SELECT a.match_id, a.track_id, a.frame_idx, a.rn, a.area <= 3e4 AND NOT (k.last > 0 AND a.area > 3 * k.last), CASE WHEN a.area <= 3e4 AND NOT (k.last > 0 AND a.area > 3 * k.last) THEN a.area ELSE k.last END
 FROM keep k JOIN areas a ON a.match_id = k.match_id AND a.track_id = k.track_id AND a.rn = k.rn + 1)"""


def widened(fx):
    wide = (F.col("x2") - F.col("x1")) * (1 + (F.col("x1") + F.col("y1")) % 5) * (1 + F.col("x1") % 3)
    return fx.players.withColumn("x2", F.col("x1") + wide)


@query("i14_area_plausibility", "WITH " + AREAS + " SELECT match_id, track_id, frame_idx, ok AS accepted FROM keep")
def i14(fx):
    """Boxes of a plausible size."""
    return ball.plausible_boxes(widened(fx), F.lit(150000.0))
