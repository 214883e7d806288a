"""Whole path from frames to minutes, in batch and as a stream."""

from pyspark.sql import functions as F

from touchline.functions import counters as cnt
from touchline.operators.scans import FRAME_BUCKET
from touchline.operators import ball, carrier, detections as det, passes as ps, rulesets as rs
from touchline.operators.joins import dealt
from touchline.plans import pass_queries as pq
from touchline.plans.registry import query
from touchline.sources import writers
from touchline.session import durable
from touchline.streaming import live

RULES = rs.get_ruleset("futsal")
C = cnt.COUNTERS

# frames to minutes for the checking engine: ball filter, zone, hysteresis, passes, accounting
SMOOTH = pq.KALMAN.replace("r.ruleset = m.ruleset", "r.ruleset = 'futsal'").rstrip()
CHAIN = SMOOTH + """,
spot AS (SELECT match_id, f AS frame_idx, CAST(trunc(x) AS BIGINT) AS cx, CAST(trunc(y) AS BIGINT) AS cy FROM ball WHERE f >= 0 AND st <> 'lost'),
near AS (SELECT p.match_id, p.frame_idx, p.track_id, p.team_id, sqrt(pow(floor((p.x1 + p.x2) / 2) - b.cx, 2) + pow(p.y2 - b.cy, 2)) AS dist,
  greatest(20, least(140, 45e-2 * greatest(1, p.y2 - p.y1))) AS radius FROM spot b JOIN fx_players p ON p.match_id = b.match_id AND p.frame_idx = b.frame_idx),
inside AS (SELECT * FROM near WHERE dist <= radius),
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame_idx ORDER BY dist, track_id) AS rn FROM inside) n WHERE rn = 1),
teams AS (SELECT match_id, frame_idx, count(DISTINCT team_id) AS n_teams FROM inside GROUP BY match_id, frame_idx),
raw AS MATERIALIZED (SELECT f.match_id, f.frame_idx, f.half, f.minute, CASE WHEN b.match_id IS NULL THEN 'oof' WHEN t.n_teams = 1 THEN 'carrier' ELSE 'loose' END AS kind,
  CASE WHEN t.n_teams = 1 THEN p.track_id END AS track_id, CASE WHEN t.n_teams = 1 THEN p.team_id END AS team_id
  FROM fx_frames f LEFT JOIN spot b ON b.match_id = f.match_id AND b.frame_idx = f.frame_idx LEFT JOIN teams t ON t.match_id = f.match_id AND t.frame_idx = f.frame_idx
  LEFT JOIN pick p ON p.match_id = f.match_id AND p.frame_idx = f.frame_idx), """ + pq.ACCOUNT.replace("fx_carrier", "raw")
KIND = {"completed": "passes_completed", "interception": "interceptions", "ball_lost": "ball_lost"}
COUNTED = ", ".join(f"CAST(count(*) FILTER (event = '{k}' AND from_team = {t}) AS INT) AS {n}_{s}" for k, n in KIND.items() for t, s in ((0, "team_a"), (1, "team_b")))
MINUTES = CHAIN + f""", counted AS (SELECT match_id, half, minute, {COUNTED} FROM frames GROUP BY ALL),
rows_ AS (SELECT e.match_id, e.half, e.minute, a AS ra, b AS rb, l AS rl, o AS ro, {", ".join("n." + c for c in C[4:])} FROM ends e JOIN counted n ON n.match_id = e.match_id AND n.half = e.half AND n.minute = e.minute),
final AS (SELECT r.match_id, r.half, r.minute,
 CAST(ra + CASE WHEN c.ck = 'flip_to' AND c.ct = 0 THEN least(c.cn, rb) WHEN c.ck = 'flip_to' OR (c.ck = 'drop' AND c.ct = 0) THEN -least(c.cn, ra) ELSE 0 END AS INT) AS frames_team_a,
 CAST(rb + CASE WHEN c.ck = 'flip_to' AND c.ct = 1 THEN least(c.cn, ra) WHEN c.ck = 'flip_to' OR (c.ck = 'drop' AND c.ct = 1) THEN -least(c.cn, rb) ELSE 0 END AS INT) AS frames_team_b,
 CAST(rl AS INT) AS frames_loose, CAST(ro + CASE WHEN c.ck = 'drop' AND c.ct = 0 THEN least(c.cn, ra) WHEN c.ck = 'drop' THEN least(c.cn, rb) ELSE 0 END AS INT) AS frames_oof,
 {", ".join(C[4:])}, CASE WHEN c.ck IS NULL THEN 0 ELSE 1 END AS revision FROM rows_ r LEFT JOIN ends c ON c.match_id = r.match_id AND c.ph = r.half AND c.pm = r.minute AND c.ck IS NOT NULL)
"""


ZONE = ["foot_zone_ratio", "foot_zone_min_px", "foot_zone_max_px"]
NEEDED = ["kalman_coast_frames", "kalman_gate_sigma", "carrier_hysteresis_n", *ZONE, *ps.PASS_INPUTS[3:]]


def chain(fx, size=FRAME_BUCKET, warmup=256, own_rules=False):
    """Raw minute rows of every match from detections, by one ruleset or by that of each match."""
    at = ["match_id", "frame_idx"]
    frames = fx.frames.select("match_id", "frame_idx", "half", "minute")
    if own_rules:
        rules = durable(rs.with_ruleset(fx.matches.select("match_id", "ruleset"), *NEEDED).select("match_id", *NEEDED), "rules")

    def ruled(df, *names):
        if own_rules:
            return df.join(rules.select("match_id", *names), "match_id")
        return df.withColumns({c: F.lit(RULES[c]) for c in names})

    seen = ruled(frames.select(*at).join(dealt(det.best_ball(fx.balls)), at, "left"), *NEEDED[:2])
    seen = seen.withColumnsRenamed({"kalman_coast_frames": "coast", "kalman_gate_sigma": "sigma"})
    smooth = ball.smooth_ball(seen, size, warmup).filter("ball_state <> 'lost'")
    spot = smooth.select(*at, F.col("bx").alias("cx"), F.col("by").alias("cy"))
    raw = carrier.raw_carrier(frames, ruled(fx.players, *ZONE), spot, *[F.col(c) for c in ZONE])
    most = max(rs.get_ruleset(name)["carrier_hysteresis_n"] for name in rs.RULESETS)
    held = carrier.commit_carrier(ruled(raw, "carrier_hysteresis_n"), F.col("carrier_hysteresis_n"), size, most)
    steps = ps.run_passes(ruled(held.drop("carrier_hysteresis_n"), *ps.PASS_INPUTS[3:]), size, warmup)
    return ps.minute_rows(steps.join(dealt(frames), at))


def corrected(rows):
    clusters = rows.select("match_id", "half", "minute", F.lit(None).cast("int").alias("team_a_cluster_id"))
    return ps.final_minutes(rows, clusters).select("match_id", "half", "minute", *C, "revision")


@query("i17_minutes_batch", "WITH " + MINUTES + "SELECT * FROM final")
def i17_batch(fx):
    """Frames to corrected minutes, all matches at once."""
    return corrected(chain(fx))


OWN = MINUTES
for _old, _new in (
    (SMOOTH, pq.KALMAN.rstrip()),
    ("greatest(20, least(140, 45e-2 * greatest(1, p.y2 - p.y1)))", "greatest(r.zone_min, least(r.zone_max, r.zone_ratio * greatest(1, p.y2 - p.y1)))"),
    ("ON p.match_id = b.match_id AND p.frame_idx = b.frame_idx),\ninside", "ON p.match_id = b.match_id AND p.frame_idx = b.frame_idx JOIN fx_matches m ON m.match_id = b.match_id JOIN fx_rules r ON r.ruleset = m.ruleset),\ninside"),
    ("f - ra > 22", "f - ra > patience"),
    ("c.half, c.minute\n    FROM fsm s", "c.half, c.minute, o.timeout AS patience\n    FROM fsm s"),
    ("JOIN committed c ON c.match_id = s.match_id AND c.frame_idx = s.f + 1)", "JOIN committed c ON c.match_id = s.match_id AND c.frame_idx = s.f + 1 JOIN fx_matches x ON x.match_id = s.match_id JOIN fx_rules o ON o.ruleset = x.ruleset)"),
):
    OWN = OWN.replace(_old, _new)


@query("i17_minutes_own_rules", "WITH " + OWN + "SELECT * FROM final")
def i17_own_rules(fx):
    """I17 with the ruleset of each match, classic and futsal together."""
    return corrected(chain(fx, own_rules=True))


def stream(fx, files=3, per_batch=2, replay=False, extra=()):
    """Clips written in scrambled order within their half, run through the live query; its output folder.

    Minute 1 of the next half always counts as expected, so the halves arrive one after the other. A half has ``files`` files
    at least and more as the table of clips does; a batch takes ``per_batch`` of ``files`` parts of them.
    """
    clips = live.clip_rows(fx.frames.withColumns(dict(extra)), fx.players, det.best_ball(fx.balls), [c for c, _ in extra])
    source, target = writers.scratch(fx.spark, "clips"), writers.scratch(fx.spark, "live")
    clips = durable(clips)
    dealt_over = max(files, len(clips.inputFiles()))
    for half in (1, 2):
        arrived = clips.filter(F.col("half") == half)
        if replay:
            arrived = arrived.unionByName(arrived.filter("minute % 2 = 0"))
        arrived.repartition(dealt_over, F.xxhash64("match_id", "half", "minute")).write.mode("append").parquet(source)
    arriving = fx.spark.readStream.schema(live.CLIP).option("maxFilesPerTrigger", -(-dealt_over * per_batch // files)).parquet(source)
    live.run_live(arriving, RULES, target).awaitTermination()
    return target


@query("i17_minutes_stream", "WITH " + MINUTES + "SELECT * FROM final")
def i17_stream(fx):
    """The same minutes from a stream of clips out of order, written batch by batch."""
    return live.minute_table(fx.spark, stream(fx)).select("match_id", "half", "minute", *C, "revision")


@query("i16_event_log", "WITH " + CHAIN + "SELECT match_id, half, minute, frame_idx, CASE event WHEN 'completed' THEN 'pass' ELSE event END AS kind, from_team, to_team, from_track, to_track, travel_frames FROM frames WHERE event IS NOT NULL")
def i16(fx):
    """I16: events written together with the minutes of their batch."""
    rows = live.written(fx.spark, stream(fx), "events")
    return rows.select("match_id", "half", "minute", "frame_idx", "kind", "from_team", "to_team", "from_track", "to_track", "travel_frames")


@query("i8_replayed_clips", "WITH " + MINUTES + "SELECT match_id, count(*) AS clips, CAST(sum(frames_team_a) AS BIGINT) AS frames_team_a, CAST(sum(passes_completed_team_b) AS BIGINT) AS passes_b FROM final GROUP BY match_id")
def i8(fx):
    """I8: clips delivered twice count once."""
    rows = live.minute_table(fx.spark, stream(fx, replay=True))
    return rows.groupBy("match_id").agg(F.count("*").alias("clips"), F.sum("frames_team_a").alias("frames_team_a"), F.sum("passes_completed_team_b").alias("passes_b"))


@query("i10_generation_reset", "WITH " + MINUTES + "SELECT match_id, half, minute, frames_team_a, frames_team_b, CASE WHEN half = 1 AND minute < 8 THEN 1 ELSE 0 END AS superseded FROM final")
def i10(fx):
    """A newer generation supersedes earlier minutes and leaves the ball and pass state."""
    wanted = F.when((F.col("half") > 1) | (F.col("minute") >= 8), 2).otherwise(1)
    rows = live.minute_table(fx.spark, stream(fx, extra=(("wanted_generation", wanted),)))
    return rows.select("match_id", "half", "minute", "frames_team_a", "frames_team_b", "superseded")
