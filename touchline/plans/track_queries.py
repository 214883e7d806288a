"""Tracks and re-identification."""

from pyspark.sql import functions as F

from touchline.operators import tracks as tk
from touchline.plans.registry import query
from touchline.sources import writers

SEEN = "seen AS (SELECT match_id, track_id, frame_idx FROM fx_players WHERE confidence >= 5e-1)"
GAPS = SEEN + """, g AS (SELECT *, lag(frame_idx) OVER (PARTITION BY match_id, track_id ORDER BY frame_idx) AS from_frame FROM seen),
gaps AS (SELECT match_id, track_id, from_frame, frame_idx AS to_frame, frame_idx - from_frame AS gap, (frame_idx - from_frame) / 15e0 AS gap_s, frame_idx - from_frame > 6 * 8e-1 AS near_limit FROM g WHERE frame_idx - from_frame > 1)"""


def seen(fx):
    return fx.players.filter("confidence >= 0.5").select("match_id", "track_id", "frame_idx")


@query("e4_track_gaps", "WITH " + GAPS + " SELECT * FROM gaps")
def e4(fx):
    """Pauses of every track."""
    return tk.gaps(seen(fx), 15.0, 6)


@query("f5_longest_gaps", "WITH " + GAPS + " SELECT match_id, track_id, from_frame, gap, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY match_id ORDER BY gap DESC, track_id, from_frame) AS INT) AS rank FROM gaps) r WHERE rank <= 20")
def f5(fx):
    """twenty longest pauses per match (a top-k report)."""
    return tk.longest_gaps(tk.gaps(seen(fx), 15.0, 6)).select("match_id", "track_id", "from_frame", "gap", "rank")


PROBE = """WITH c AS (SELECT match_id, frame_idx, count(*) AS n FROM fx_players WHERE confidence >= 9e-1 GROUP BY ALL)
SELECT match_id, min(coalesce(n, 0)) AS fewest, max(coalesce(n, 0)) AS most, round(avg(coalesce(n, 0)), 9) AS mean, max(coalesce(n, 0)) < 6 AS too_few
FROM fx_frames LEFT JOIN c USING (match_id, frame_idx) {} GROUP BY match_id"""


@query("d16_detections_per_frame", PROBE.format(""))
def d16_all(fx):
    """Detections per frame over whole matches."""
    return tk.detection_probe(fx.frames, fx.players.filter("confidence >= 0.9")).withColumn("mean", F.round("mean", 9))


@query("d16_detection_probe", PROBE.format("WHERE frame_idx < 60"))
def d16(fx):
    """Detections per frame over the first frames (the probe's own parameter)."""
    probe = tk.detection_probe(fx.frames, fx.players.filter("confidence >= 0.9"), 60)
    return probe.withColumn("mean", F.round("mean", 9))


VOTES = "SELECT match_id, track_id, frame_idx, CAST(CASE WHEN y2 % 3 = 0 THEN NULL WHEN x1 % 5 < 2 THEN 0 ELSE (x1 + y1) % 2 END AS INT) AS team_id FROM fx_players"


@query("d12_majority_team", f"""WITH v AS ({VOTES}), c AS (SELECT match_id, track_id, team_id, count(*) AS n, min(frame_idx) AS since FROM v WHERE team_id IS NOT NULL GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY match_id, track_id ORDER BY n DESC, since) AS rn FROM c)
SELECT t.match_id, t.track_id, coalesce(b.team_id, 0) AS team_id FROM (SELECT DISTINCT match_id, track_id FROM v) t LEFT JOIN b ON b.match_id = t.match_id AND b.track_id = t.track_id AND b.rn = 1""")
def d12(fx):
    """Most voted team per track."""
    return tk.majority_team(fx.sql(VOTES))


@query("d13_running_team", f"""WITH v AS ({VOTES}), r AS (SELECT *, sum(CASE WHEN team_id = 0 THEN 1 ELSE 0 END) OVER w AS n0, sum(CASE WHEN team_id = 1 THEN 1 ELSE 0 END) OVER w AS n1,
 first_value(team_id IGNORE NULLS) OVER w AS f FROM v WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING))
SELECT match_id, track_id, frame_idx, CAST(CASE WHEN n0 > n1 THEN 0 WHEN n1 > n0 THEN 1 ELSE coalesce(f, 0) END AS INT) AS team_so_far FROM r""")
def d13(fx):
    """Team of a track as known so far."""
    return tk.running_team(fx.sql(VOTES)).select("match_id", "track_id", "frame_idx", "team_so_far")


@query("f7_gallery", """SELECT match_id, track_id, arrival, sharpness, slot FROM (SELECT *, CAST(row_number() OVER (PARTITION BY match_id, track_id ORDER BY sharpness DESC, arrival) AS INT) AS slot
 FROM fx_crops WHERE crop_w >= 32 AND crop_h >= 32 AND sharpness >= 80) c WHERE slot <= 5""")
def f7(fx):
    """five sharpest crops per track (the gallery's own size)."""
    return tk.gallery(fx.crops).select("match_id", "track_id", "arrival", "sharpness", "slot")


@query("f8_best_number", """WITH r AS (SELECT *, regexp_replace(ocr_text, '[^0-9]', '', 'g') AS digits FROM fx_crops WHERE ocr_conf >= 75e-2)
SELECT match_id, track_id, digits, ocr_conf FROM (SELECT *, row_number() OVER (PARTITION BY match_id, track_id ORDER BY ocr_conf DESC, arrival) AS rn FROM r WHERE digits <> '') x WHERE rn = 1""")
def f8(fx):
    """F8: best shirt number per track."""
    return tk.best_number(fx.crops)


# boxes close enough for some to overlap
CLOSE = "SELECT match_id, frame_idx, track_id, x1 % 160 AS x1, y1 % 90 AS y1, x1 % 160 + 60 AS x2, y1 % 90 + 80 AS y2 FROM fx_players"
IOU = """greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / CAST((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
 - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS DOUBLE)"""
# one key per frame, and the pairs of a frame before any test on them
PAIRS = f"""c AS MATERIALIZED (SELECT *, concat(match_id, ':', CAST(frame_idx AS VARCHAR)) AS mf FROM ({CLOSE}) x),
met AS MATERIALIZED (SELECT a.match_id, a.frame_idx, a.track_id AS a, b.track_id AS b, {IOU} AS iou FROM c a JOIN c b ON b.mf = a.mf),
pairs AS (SELECT * FROM met WHERE a < b)"""


@query("c9_duplicate_pairs", f"WITH {PAIRS} SELECT * FROM pairs WHERE iou >= 6e-1")
def c9(fx):
    """Tracks on top of each other in a frame."""
    return tk.duplicate_pairs(fx.sql(CLOSE))


@query("c9_overlapping_pairs", f"WITH {PAIRS} SELECT * FROM pairs WHERE iou >= 3e-1")
def c9_overlapping(fx):
    """The same at a bar below one half."""
    return tk.duplicate_pairs(fx.sql(CLOSE), 0.3)


SHIFTED = "SELECT match_id, frame_idx, track_id, x1 % 160 + frame_idx % 40 AS x1, y1 % 90 AS y1, x1 % 160 + frame_idx % 40 + 60 AS x2, y1 % 90 + 80 AS y2 FROM fx_players WHERE confidence >= 7e-1"


@query("c10_new_detections", f"""WITH a AS ({CLOSE}), b AS ({SHIFTED}), best AS (SELECT a.match_id, a.frame_idx, a.track_id, max({IOU}) AS best_iou FROM a JOIN b ON b.match_id = a.match_id AND b.frame_idx = a.frame_idx GROUP BY ALL)
SELECT a.match_id, a.frame_idx, a.track_id AS det_id, coalesce(best_iou, 0e0) AS best_iou FROM a LEFT JOIN best USING (match_id, frame_idx, track_id) WHERE coalesce(best_iou, 0e0) < 3e-1""")
def c10(fx):
    """Detections no active track covers."""
    found = tk.new_detections(fx.sql(CLOSE).withColumnRenamed("track_id", "det_id"), fx.sql(SHIFTED))
    return found.select("match_id", "frame_idx", "det_id", "best_iou")


MERGED = f"""{PAIRS}, links AS (SELECT DISTINCT match_id, a, b FROM pairs WHERE iou >= 75e-2), both_ways AS (SELECT * FROM links UNION SELECT match_id, b, a FROM links),
reach AS (SELECT match_id, a, b FROM both_ways UNION SELECT r.match_id, r.a, l.b FROM reach r JOIN both_ways l ON l.match_id = r.match_id AND l.a = r.b),
merged AS (SELECT match_id, a AS track_id, least(a, min(b)) AS keep_id FROM reach GROUP BY match_id, a)"""


def merged(fx):
    return tk.merge_ids(tk.duplicate_pairs(fx.sql(CLOSE), 0.75))


@query("i13_merged_ids", f"WITH {MERGED} SELECT * FROM merged")
def i13(fx):
    """Surviving id of every merged track."""
    return merged(fx)


@query("g3_surviving_tracks", f"WITH {MERGED} SELECT DISTINCT p.match_id, p.track_id FROM fx_players p WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.match_id = p.match_id AND m.track_id = p.track_id AND m.keep_id <> m.track_id)")
def g3(fx):
    """Tracks that were not merged away."""
    return tk.surviving_tracks(fx.players.select("match_id", "track_id").distinct(), merged(fx))


CANDIDATES = """dots AS (SELECT a.match_id, a.frame_idx, a.pos AS raw_id, CAST(floor(b.pos / 4) AS BIGINT) AS stable_id, max(b.frame_idx) OVER (PARTITION BY b.match_id, CAST(floor(b.pos / 4) AS BIGINT)) AS x,
  list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(CAST(a.embedding AS DOUBLE[]), lambda x: x * x)))
  * sqrt(list_sum(list_transform(CAST(b.embedding AS DOUBLE[]), lambda x: x * x))) + 1e-8) AS sim FROM fx_vectors a JOIN fx_vectors b ON b.match_id = a.match_id WHERE a.pos % 2 = 1 AND b.pos % 2 = 0),
lasts AS (SELECT match_id, CAST(floor(pos / 4) AS BIGINT) AS stable_id, max(frame_idx) AS last_seen FROM fx_vectors WHERE pos % 2 = 0 GROUP BY ALL),
top AS (SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY d.match_id, d.frame_idx, raw_id ORDER BY sim DESC, d.stable_id) AS rn FROM dots d JOIN lasts l ON l.match_id = d.match_id AND l.stable_id = d.stable_id
 WHERE d.frame_idx - l.last_seen > 60 AND d.frame_idx - l.last_seen <= 1500) r WHERE rn = 1),
cand AS (SELECT v.match_id, v.frame_idx, v.pos AS raw_id, t.stable_id AS candidate_id, t.sim AS similarity FROM fx_vectors v LEFT JOIN top t ON t.match_id = v.match_id AND t.frame_idx = v.frame_idx AND t.raw_id = v.pos WHERE v.pos % 2 = 1)"""


def candidates(fx):
    v = fx.vectors
    new = v.filter("pos % 2 = 1").select("match_id", "frame_idx", F.col("pos").alias("raw_id"), "embedding")
    shots = v.filter("pos % 2 = 0").select("match_id", F.floor(F.col("pos") / 4).alias("stable_id"), "frame_idx", "embedding")
    last = shots.groupBy("match_id", "stable_id").agg(F.max("frame_idx").alias("last_seen"))
    lost = shots.drop("frame_idx").join(last, ["match_id", "stable_id"])
    return tk.reid_candidates(new, lost, 60, 1500)


@query("c8_reid_candidates", f"WITH {CANDIDATES} SELECT match_id, frame_idx, raw_id, candidate_id, round(similarity, 6) AS similarity FROM cand")
def c8(fx):
    """Most similar lost track of every new one."""
    return candidates(fx).withColumn("similarity", F.round("similarity", 6))


# proposals with outside verdicts and number readings, many per frame
PROPOSALS = """SELECT match_id, CAST(floor(frame_idx / 4) AS BIGINT) AS frame_idx, CAST(frame_idx % 4 AS BIGINT) * 100 + k AS raw_id, CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(event_id % 3 AS BIGINT) END AS candidate_id,
 CASE WHEN k % 9 = 0 THEN NULL ELSE (50e0 + k / 2e0) / 100e0 END AS similarity, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 4 = 1 END AS verdict,
 CASE WHEN event_id % 5 = 0 THEN CAST(k % 2 AS VARCHAR(20)) END AS digits, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 2 AS VARCHAR(20)) END AS stored_digits FROM fx_frames"""
DECISIONS = f"""p AS ({PROPOSALS}), t AS (SELECT *, coalesce(similarity, -1e0) AS s, candidate_id IS NOT NULL AND (coalesce(similarity, -1e0) >= 85e-2 OR (coalesce(similarity, -1e0) >= 65e-2 AND coalesce(verdict, false))) AS passes,
 coalesce(digits <> stored_digits, false) AS veto FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY match_id, frame_idx ORDER BY s DESC, raw_id) AS place,
 coalesce(sum(CASE WHEN passes AND NOT veto THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, frame_idx, candidate_id ORDER BY s DESC, raw_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS taken FROM t),
d AS (SELECT *, passes AND NOT veto AND NOT taken AS matched, CASE WHEN candidate_id IS NULL OR taken THEN NULL WHEN s >= 85e-2 THEN 'reid_high_conf' WHEN s >= 65e-2 AND verdict IS NULL THEN 'reid_vlm_skipped_no_ref'
 WHEN s >= 65e-2 THEN 'reid_vlm_checked' ELSE 'reid_below_threshold' END AS event, passes AND veto AND NOT taken AS vetoed FROM o),
decisions AS (SELECT match_id, frame_idx, raw_id, candidate_id, similarity, event, vetoed, matched, verdict, digits, stored_digits,
 CASE WHEN NOT matched THEN CAST(row_number() OVER (PARTITION BY match_id, matched ORDER BY frame_idx, place) - 1 AS BIGINT) END AS new_id FROM d)"""


@query("i11_reid_decisions", f"WITH {DECISIONS} SELECT match_id, frame_idx, raw_id, candidate_id, similarity, event, vetoed, matched, new_id FROM decisions")
def i11(fx):
    """Lost tracks claimed by new ones."""
    return tk.reid_decisions(fx.sql(PROPOSALS))


@query("a14_reid_log", f"""WITH {DECISIONS} SELECT match_id, frame_idx AS frame, event, raw_id, CASE WHEN event = 'reid_high_conf' THEN candidate_id END AS matched_stable_id, similarity FROM decisions WHERE event IS NOT NULL
UNION ALL SELECT match_id, frame_idx, 'ocr_veto', raw_id, NULL, NULL FROM decisions WHERE vetoed UNION ALL SELECT match_id, frame_idx, 'new_track', raw_id, new_id, NULL FROM decisions WHERE new_id IS NOT NULL""")
def a14(fx):
    """Decision log as CSV, read back."""
    proposals = fx.sql(PROPOSALS)
    path = writers.scratch(fx.spark, "reid-log")
    rows = tk.reid_log(proposals, tk.reid_decisions(proposals))
    writers.write_csv(rows.select("match_id", *writers.REID_FIELDS), path, order=["match_id", "frame", "raw_id"])
    types = {"frame": "bigint", "raw_id": "bigint", "matched_stable_id": "bigint", "candidate_stable_id": "bigint", "similarity": "double"}
    ddl = "match_id string, " + ", ".join(f"{f} {types.get(f, 'string')}" for f in writers.REID_FIELDS)
    return writers.read_csv(fx.spark, path, ddl).select("match_id", "frame", "event", "raw_id", "matched_stable_id", "similarity")


@query("i12_gallery_expiry", """WITH s AS (SELECT match_id, track_id, frame_idx FROM fx_players WHERE confidence >= 85e-2), n AS (SELECT match_id, count(*) AS n_frames FROM fx_frames GROUP BY match_id),
x AS (SELECT s.*, n_frames, lead(frame_idx) OVER (PARTITION BY s.match_id, track_id ORDER BY frame_idx) AS nxt, CAST(ceil((frame_idx + 13) / 30e0) * 30 AS BIGINT) AS chk FROM s JOIN n USING (match_id)),
e AS (SELECT *, CASE WHEN chk < n_frames AND (nxt IS NULL OR chk < nxt) THEN chk WHEN nxt IS NULL AND n_frames - frame_idx > 12 THEN n_frames END AS expired_at FROM x)
SELECT match_id, track_id, frame_idx AS last_seen, expired_at FROM e WHERE expired_at IS NOT NULL""")
def i12(fx):
    """Tracks forgotten after their time is up."""
    ends = fx.frames.groupBy("match_id").agg(F.count("*").alias("n_frames"))
    return tk.gallery_expiry(fx.players.filter("confidence >= 0.85"), ends, 12)


@query("a13_track_file", f"""WITH v AS ({VOTES}), c AS (SELECT match_id, track_id, team_id, count(*) AS n, min(frame_idx) AS since FROM v WHERE team_id IS NOT NULL GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY match_id, track_id ORDER BY n DESC, since) AS rn FROM c)
SELECT d.match_id, d.frame_idx AS frame, d.frame_idx / 15e0 AS timestamp_s, d.track_id, coalesce(b.team_id, 0) AS team, round(x1 + 125e-3, 1) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2, confidence
FROM fx_players d LEFT JOIN b ON b.match_id = d.match_id AND b.track_id = d.track_id AND b.rn = 1""")
def a13(fx):
    """Track file as CSV, read back."""
    boxes = fx.players.drop("team_id").withColumn("x1", F.col("x1") + 0.125)
    path = writers.scratch(fx.spark, "tracks")
    rows = tk.track_rows(boxes, tk.majority_team(fx.sql(VOTES)), 15.0)
    writers.write_csv(rows, path, order=["match_id", "frame", "track_id"])
    ddl = "match_id string, frame bigint, timestamp_s double, track_id bigint, team int, x1 double, y1 double, x2 double, y2 double, confidence double"
    return writers.read_csv(fx.spark, path, ddl)
