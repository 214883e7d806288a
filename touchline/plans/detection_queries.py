"""Detections, rulesets, possession of the ball per frame."""

from pyspark.sql import functions as F

from touchline.operators import carrier, detections as det, rulesets as rs
from touchline.plans.registry import query
from touchline.session import durable

# ruleset values for the checking engine
RULES = """fx_rules AS (SELECT * FROM (VALUES
 ('classic', 5e-1, 25e-2, 65e-2, 55e0, 24, 90, 20, 8e0, 45e-2, 14, 100, 3, 45),
 ('futsal', 5e-1, 25e-2, 55e-2, 80e0, 32, 60, 12, 6e0, 45e-2, 20, 140, 3, 22)) r(ruleset, player_conf, ball_conf, torso_ratio,
 blur_threshold, min_crop_px, track_buffer, coast, sigma, zone_ratio, zone_min, zone_max, hysteresis, timeout))"""


def ruled(fx, df, *columns):
    """Rows with the parameters of their match.

    The rows of the matches are written first: with their size known they are the smaller side, not the boxes.
    """
    rules = durable(rs.with_ruleset(fx.matches.select("match_id", "ruleset"), *columns), "rules")
    return df.join(rules, "match_id")


def named(fx):
    return det.name_classes(ruled(fx, fx.detections, "class_names", "player_conf", "ball_conf"), F.col("class_names"))


def gated(fx):
    return det.gate_confidence(named(fx), F.col("player_conf"), F.col("ball_conf"))


def pointed(fx):
    return det.with_points(gated(fx))


NAMED = RULES + """, named AS (SELECT d.*, r.player_conf, r.ball_conf, m.ruleset,
  CASE WHEN class_id = 0 THEN 'active_player' WHEN class_id = 1 THEN 'ball'
       WHEN class_id = 2 THEN CASE WHEN m.ruleset = 'futsal' THEN 'goal_post' ELSE 'referee' END
       WHEN class_id = 3 AND m.ruleset = 'futsal' THEN 'referee' ELSE concat('cls_', class_id) END AS class_name
  FROM fx_detections d JOIN fx_matches m ON m.match_id = d.match_id JOIN fx_rules r ON r.ruleset = m.ruleset),
gated AS (SELECT * FROM named WHERE confidence >= CASE WHEN class_name = 'ball' THEN ball_conf ELSE player_conf END),
pointed AS (SELECT match_id, frame_idx, det_id, class_name, confidence,
  CAST(trunc(x1) AS BIGINT) AS x1, CAST(trunc(y1) AS BIGINT) AS y1, CAST(trunc(x2) AS BIGINT) AS x2, CAST(trunc(y2) AS BIGINT) AS y2,
  CAST(floor((trunc(x1) + trunc(x2)) / 2) AS BIGINT) AS foot_x, CAST(trunc(y2) AS BIGINT) AS foot_y,
  CAST(floor((trunc(x1) + trunc(x2)) / 2) AS BIGINT) AS cx, CAST(floor((trunc(y1) + trunc(y2)) / 2) AS BIGINT) AS cy FROM gated)
"""


@query("a1_rulesets", "WITH " + RULES + """
SELECT m.match_id, m.ruleset, r.blur_threshold, CAST(r.min_crop_px AS INT) AS min_crop_px, CAST(r.coast AS INT) AS kalman_coast_frames,
 r.sigma AS kalman_gate_sigma, CAST(r.zone_min AS INT) AS foot_zone_min_px, CAST(r.timeout AS INT) AS travel_timeout_frames
FROM fx_matches m JOIN fx_rules r USING (ruleset)""")
def a1(fx):
    """A1: ruleset parameters of every match."""
    cols = ["blur_threshold", "min_crop_px", "kalman_coast_frames", "kalman_gate_sigma", "foot_zone_min_px", "travel_timeout_frames"]
    return rs.with_ruleset(fx.matches.select("match_id", "ruleset"), *cols).select("match_id", "ruleset", *cols)


@query("a2_scan_detections", """SELECT match_id, count(*) AS n_boxes, count(DISTINCT frame_idx) AS n_frames, round(sum(x2 - x1), 3) AS total_width
FROM fx_detections GROUP BY match_id""")
def a2(fx):
    """A2: scan of the detections table."""
    return fx.detections.groupBy("match_id").agg(
        F.count("*").alias("n_boxes"), F.countDistinct("frame_idx").alias("n_frames"),
        F.round(F.sum(F.col("x2") - F.col("x1")), 3).alias("total_width"))


@query("b1_class_names", "WITH " + NAMED + "SELECT match_id, frame_idx, det_id, class_id, class_name FROM named")
def b1(fx):
    """B1: class names with a fallback."""
    return named(fx).select("match_id", "frame_idx", "det_id", "class_id", "class_name")


@query("b2_confidence_gate", "WITH " + NAMED + "SELECT match_id, frame_idx, det_id, class_name, confidence FROM gated")
def b2(fx):
    """B2: confidence bar per class."""
    return gated(fx).select("match_id", "frame_idx", "det_id", "class_name", "confidence")


@query("b3_box_points", "WITH " + NAMED + "SELECT * FROM pointed")
def b3(fx):
    """Whole-pixel boxes, foot points and centres."""
    return pointed(fx).select("match_id", "frame_idx", "det_id", "class_name", "confidence", "x1", "y1", "x2", "y2",
                              "foot_x", "foot_y", "cx", "cy")


@query("b4_routes", "WITH " + NAMED + """, routed AS (SELECT match_id, frame_idx, CASE class_name WHEN 'active_player' THEN 'players'
 WHEN 'referee' THEN 'referees' WHEN 'goal_post' THEN 'goal_posts' WHEN 'ball' THEN 'balls' END AS list FROM gated)
SELECT match_id, list, count(*) AS n, count(DISTINCT frame_idx) AS frames FROM routed WHERE list IS NOT NULL GROUP BY match_id, list""")
def b4(fx):
    """Rows routed into the four lists of a frame, from one scan."""
    lists = F.create_map(*[F.lit(x) for name, cls in det.ROUTES.items() for x in (cls, name)])
    routed = gated(fx).withColumn("list", F.try_element_at(lists, F.col("class_name"))).filter("list IS NOT NULL")
    return routed.groupBy("match_id", "list").agg(F.count("*").alias("n"), F.countDistinct("frame_idx").alias("frames"))


@query("b5_timestamps", """SELECT match_id, frame_idx, round(frame_idx / greatest(CASE WHEN mno % 3 = 0 THEN 5e-1 ELSE 24e0 + mno END, 1e0), 6) AS timestamp_s FROM fx_frames""")
def b5(fx):
    """Seconds from frame number."""
    fps = F.when(F.col("mno") % 3 == 0, 0.5).otherwise(24.0 + F.col("mno"))
    return fx.frames.select("match_id", "frame_idx", F.round(det.timestamp_s(F.col("frame_idx"), fps), 6).alias("timestamp_s"))


@query("b6_stride", """SELECT match_id, frame_idx FROM fx_frames
WHERE frame_idx % CAST(greatest(1, round_even((12e0 + 7.5e0 * mno) / 15e0, 0)) AS BIGINT) = 0""")
def b6(fx):
    """Processed frames by rate."""
    return det.stride(fx.frames, 12.0 + 7.5 * F.col("mno")).select("match_id", "frame_idx")


@query("b7_sample_every", "SELECT match_id, frame_idx, holder FROM fx_frames WHERE frame_idx % 30 = 0")
def b7(fx):
    """Every n-th frame (the sampling operator)."""
    return det.sample_every(fx.frames, 30).select("match_id", "frame_idx", "holder")


@query("b8_resample_fps", """WITH slots AS (SELECT match_id, frame_idx, CAST(floor(frame_idx * 15e0 / (20e0 + mno)) AS BIGINT) AS slot FROM fx_frames),
opens AS (SELECT *, lag(slot) OVER (PARTITION BY match_id ORDER BY frame_idx) AS before FROM slots)
SELECT match_id, frame_idx, kept_idx FROM (SELECT match_id, frame_idx,
  CAST(row_number() OVER (PARTITION BY match_id ORDER BY frame_idx) - 1 AS BIGINT) AS kept_idx
  FROM opens WHERE before IS NULL OR slot > before) x""")
def b8(fx):
    """Resampling of whole matches to a lower rate."""
    return det.resample_fps(fx.frames, 20.0 + F.col("mno"), 15.0).select("match_id", "frame_idx", "kept_idx")


# crops from nothing to a few hundred pixels, torsos of about a third of them
SMALL = """SELECT match_id, frame_idx, track_id, CAST((x1 + frame_idx) % 24 AS INT) AS crop_w, CAST(y2 % 31 AS INT) AS crop_h,
 CAST(floor(((x1 + frame_idx) % 24) * 6 / 10) AS INT) AS torso_w, CAST(floor((y2 % 31) / 2) AS INT) AS torso_h FROM fx_players"""


@query("b9_area_gate", f"""SELECT match_id, frame_idx, track_id, torso_w * torso_h * 3 >= 400 AS torso, CASE WHEN torso_w * torso_h * 3 >= 400 THEN torso_w ELSE crop_w END AS used_w,
 CASE WHEN torso_w * torso_h * 3 >= 400 THEN torso_h ELSE crop_h END AS used_h FROM ({SMALL}) s WHERE crop_w * crop_h * 3 >= 400""")
def b9_area(fx):
    """Crops by area, small torsos falling back to the whole crop."""
    return det.area_gate(fx.sql(SMALL)).select("match_id", "frame_idx", "track_id", "torso", "used_w", "used_h")


@query("b9_crop_gate", "WITH " + RULES + """
SELECT c.match_id, c.frame_idx, c.track_id, c.crop_w, c.crop_h, c.sharpness FROM fx_crops c JOIN fx_matches m USING (match_id) JOIN fx_rules r USING (ruleset)
WHERE c.crop_w >= r.min_crop_px AND c.crop_h >= r.min_crop_px AND c.sharpness > r.blur_threshold""")
def b9(fx):
    """Crops large and sharp enough for fitting."""
    crops = ruled(fx, fx.crops, "min_crop_px", "blur_threshold")
    return det.crop_gate(crops, F.col("min_crop_px"), F.col("blur_threshold")).select(
        "match_id", "frame_idx", "track_id", "crop_w", "crop_h", "sharpness")


@query("b10_allow_list", "WITH " + NAMED + "SELECT match_id, frame_idx, det_id, class_name FROM named WHERE class_name IN ('active_player', 'referee')")
def b10(fx):
    """Class allow-list."""
    return det.allow_classes(named(fx), ["active_player", "referee"]).select("match_id", "frame_idx", "det_id", "class_name")


@query("b11_duration_cap", "SELECT match_id, frame_idx FROM fx_frames WHERE frame_idx < CAST(trunc((5e-1 + mno / 8e0) * 480) AS BIGINT)")
def b11(fx):
    """Frames of the first 480 seconds (the operator's own parameter)."""
    return det.cap_duration(fx.frames, 0.5 + F.col("mno") / 8.0, 480.0).select("match_id", "frame_idx")


@query("b13_prefix_predicate", """SELECT match_id, half, minute, frames_team_a FROM fx_minute_stats WHERE half < 2 OR (half = 2 AND minute <= 7)""")
def b13(fx):
    """Rows up to a (half, minute)."""
    from touchline.operators.minutes import upto
    return fx.minute_stats.filter(upto(F.lit(2), F.lit(7))).select("match_id", "half", "minute", "frames_team_a")


@query("b14_not_superseded", "SELECT match_id, half, minute, frames_oof FROM fx_minute_stats WHERE superseded = 0")
def b14(fx):
    """Rows that still count."""
    return fx.minute_stats.filter("superseded = 0").select("match_id", "half", "minute", "frames_oof")


ZONE = RULES + """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame_idx ORDER BY confidence DESC, ball_no) AS rn FROM fx_balls) b WHERE rn = 1),
zone AS MATERIALIZED (SELECT p.match_id, p.frame_idx, p.track_id, p.team_id, sqrt(pow(floor((p.x1 + p.x2) / 2) - b.cx, 2) + pow(p.y2 - b.cy, 2)) AS dist,
  greatest(r.zone_min, least(r.zone_max, r.zone_ratio * greatest(1, p.y2 - p.y1))) AS radius
  FROM best b JOIN fx_players p ON p.match_id = b.match_id AND p.frame_idx = b.frame_idx
  JOIN fx_matches m ON m.match_id = b.match_id JOIN fx_rules r ON r.ruleset = m.ruleset),
near AS (SELECT * FROM zone WHERE dist <= radius),
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame_idx ORDER BY dist, track_id) AS rn FROM near) n WHERE rn = 1),
teams AS (SELECT match_id, frame_idx, count(DISTINCT team_id) AS n_teams, count(*) AS n_near FROM near GROUP BY match_id, frame_idx),
raw AS (SELECT f.match_id, f.frame_idx, f.half, f.minute,
  CASE WHEN b.match_id IS NULL THEN 'oof' WHEN t.n_teams = 1 THEN 'carrier' ELSE 'loose' END AS kind,
  CASE WHEN t.n_teams = 1 THEN p.track_id END AS track_id, CASE WHEN t.n_teams = 1 THEN p.team_id END AS team_id
  FROM fx_frames f LEFT JOIN best b ON b.match_id = f.match_id AND b.frame_idx = f.frame_idx
  LEFT JOIN teams t ON t.match_id = f.match_id AND t.frame_idx = f.frame_idx
  LEFT JOIN pick p ON p.match_id = f.match_id AND p.frame_idx = f.frame_idx)
"""
ZONE_COLS = ("foot_zone_ratio", "foot_zone_min_px", "foot_zone_max_px")


def zone_args():
    return [F.col(c) for c in ZONE_COLS]


def near_pairs(fx):
    return carrier.in_zone(ruled(fx, fx.players, *ZONE_COLS), det.best_ball(fx.balls), *zone_args())


def raw(fx):
    return carrier.raw_carrier(fx.frames.select("match_id", "frame_idx", "half", "minute"),
                               ruled(fx, fx.players, *ZONE_COLS), det.best_ball(fx.balls), *zone_args())


@query("f1_best_ball", "WITH " + ZONE + "SELECT match_id, frame_idx, ball_no, cx, cy, confidence FROM best")
def f1(fx):
    """most confident ball of each frame."""
    return det.best_ball(fx.balls)


@query("b19_foot_zone", "WITH " + ZONE + "SELECT match_id, frame_idx, track_id, team_id, round(dist, 6) AS dist, round(radius, 6) AS radius FROM near")
def b19(fx):
    """Players whose foot zone holds the ball."""
    radius = carrier.zone_radius(F.col("y1"), F.col("y2"), *zone_args())
    return near_pairs(fx).select("match_id", "frame_idx", "track_id", "team_id", F.round("dist", 6).alias("dist"), F.round(radius, 6).alias("radius"))


@query("c1_ball_players", "WITH " + ZONE + "SELECT match_id, frame_idx, n_near, n_teams FROM teams")
def c1(fx):
    """Ball joined to the players of its frame within the zone."""
    return near_pairs(fx).groupBy("match_id", "frame_idx").agg(F.count("*").alias("n_near"), F.countDistinct("team_id").alias("n_teams"))


@query("d29_teams_in_zone", "WITH " + ZONE + "SELECT match_id, kind, count(*) AS frames, count(track_id) AS carried FROM raw GROUP BY match_id, kind")
def d29(fx):
    """Frames by raw state; two teams in the zone make it loose."""
    return raw(fx).groupBy("match_id", "kind").agg(F.count("*").alias("frames"), F.count("track_id").alias("carried"))


@query("f2_nearest_player", "WITH " + ZONE + "SELECT match_id, frame_idx, kind, track_id, team_id FROM raw")
def f2(fx):
    """nearest player in the zone, per frame."""
    return raw(fx).select("match_id", "frame_idx", "kind", "track_id", "team_id")


COMMIT = """same AS (SELECT *, CASE WHEN kind = lag(kind) OVER w AND track_id IS NOT DISTINCT FROM lag(track_id) OVER w THEN 0 ELSE 1 END AS change
  FROM {raw} WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)),
runs AS (SELECT *, sum(change) OVER (PARTITION BY match_id ORDER BY frame_idx) AS run FROM same),
lengths AS (SELECT *, row_number() OVER (PARTITION BY match_id, run ORDER BY frame_idx) AS len FROM runs),
marks AS (SELECT *, max(CASE WHEN len >= 3 THEN frame_idx END) OVER (PARTITION BY match_id ORDER BY frame_idx) AS at FROM lengths),
committed AS MATERIALIZED (SELECT m.match_id, m.frame_idx, m.half, m.minute, coalesce(s.kind, 'oof') AS kind, s.track_id, s.team_id
  FROM marks m LEFT JOIN {raw} s ON s.match_id = m.match_id AND s.frame_idx = m.at)
"""


@query("e1_carrier_hysteresis", "WITH " + ZONE + ", " + COMMIT.format(raw="raw") + "SELECT match_id, frame_idx, kind, track_id, team_id FROM committed")
def e1(fx):
    """Carrier state committed after three agreeing frames."""
    return carrier.commit_carrier(raw(fx), 3).select("match_id", "frame_idx", "kind", "track_id", "team_id")


@query("e13_frame_windows", "SELECT match_id, CAST(floor(frame_idx / 16) AS BIGINT) AS batch, count(*) AS frames, min(frame_idx) AS first_frame FROM fx_frames GROUP BY 1, 2")
def e13(fx):
    """Batches of 16 frames."""
    return fx.frames.groupBy("match_id", det.frame_windows(F.col("frame_idx")).alias("batch")).agg(
        F.count("*").alias("frames"), F.min("frame_idx").alias("first_frame"))
