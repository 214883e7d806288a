"""Re-identification along time."""

from pyspark.sql import functions as F

from touchline.operators import reid, tracks as tk
from touchline.plans.registry import query
from touchline.plans.track_queries import CLOSE, MERGED, PAIRS, VOTES, merged
from touchline.sources import writers

GAP, TTL, HIGH, LOW = 60, 800, 0.27, 0.15

# one raw track per vector; its end, number readings and outside verdict follow from its id
RAW = """raw AS (SELECT match_id, pos AS raw_id, frame_idx AS first, frame_idx + 5 + (vec_id * 7) % 90 AS last, CAST(embedding AS DOUBLE[]) AS e, -(80 + (vec_id * 37) % 100) AS blur, vec_id AS arrival,
 CASE WHEN vec_id % 5 = 0 THEN CAST(label % 2 AS VARCHAR) END AS digits, CASE WHEN vec_id % 4 <> 0 THEN vec_id % 4 = 1 END AS verdict,
 CASE WHEN vec_id % 3 = 0 THEN CAST(label % 2 AS VARCHAR) END AS nd, CASE WHEN vec_id % 3 = 0 THEN (50 + vec_id % 40) / 100e0 END AS nc, row_number() OVER (PARTITION BY match_id ORDER BY frame_idx) AS n FROM fx_vectors)"""
CLAIMS = RAW + f""", walk AS (
SELECT DISTINCT match_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id BIGINT, last BIGINT, shots STRUCT(b BIGINT, a BIGINT, e DOUBLE[])[], nd VARCHAR, nc DOUBLE)[]) AS pool, CAST(0 AS BIGINT) AS fresh,
 CAST(NULL AS BIGINT) AS frame_idx, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS raw_id, CAST(NULL AS BIGINT) AS candidate_id, CAST(NULL AS DOUBLE) AS similarity, CAST(NULL AS VARCHAR) AS event, false AS vetoed, false AS matched, CAST(NULL AS BIGINT) AS stable_id FROM raw
UNION ALL
SELECT match_id, n, CASE WHEN hit THEN list_append(list_filter(pool, lambda x: x.id <> cand), {{'id': cand, 'last': last, 'shots': list_sort(list_append(held.shots, shot))[1:5],
  'nd': CASE WHEN held.nc IS NOT NULL AND (nc IS NULL OR held.nc >= nc) THEN held.nd ELSE nd END, 'nc': CASE WHEN held.nc IS NOT NULL AND (nc IS NULL OR held.nc >= nc) THEN held.nc ELSE nc END}})
  ELSE list_append(pool, {{'id': fresh, 'last': last, 'shots': [shot], 'nd': nd, 'nc': nc}}) END,
 CASE WHEN hit THEN fresh ELSE fresh + 1 END, first, last, raw_id, cand, sim, event, ok AND veto, hit, CASE WHEN hit THEN cand ELSE fresh END
FROM (SELECT *, ok AND NOT veto AS hit FROM (
 SELECT *, coalesce(sim >= {HIGH} OR (sim >= {LOW} AND coalesce(verdict, false)), false) AS ok, coalesce(digits <> held.nd, false) AS veto,
  CASE WHEN cand IS NULL THEN NULL WHEN sim >= {HIGH} THEN 'reid_high_conf' WHEN sim >= {LOW} AND verdict IS NULL THEN 'reid_vlm_skipped_no_ref' WHEN sim >= {LOW} THEN 'reid_vlm_checked' ELSE 'reid_below_threshold' END AS event
 FROM (SELECT *, best.sim AS sim, -best.back AS cand, list_filter(pool, lambda x: x.id = -best.back)[1] AS held, {{'b': blur, 'a': arrival, 'e': e}} AS shot
 FROM (SELECT r.*, w.pool, w.fresh, list_max(list_transform(list_filter(w.pool, lambda x: r.first - x.last > {GAP} AND r.first - x.last <= {TTL}),
  lambda x: {{'sim': list_max(list_transform(x.shots, lambda s: list_dot_product(s.e, r.e) / (sqrt(list_dot_product(s.e, s.e)) * sqrt(list_dot_product(r.e, r.e)) + 1e-8))), 'back': -x.id}})) AS best
  FROM walk w JOIN raw r ON r.match_id = w.match_id AND r.n = w.n + 1) b) c) d) f),
claimed AS (SELECT * EXCLUDE (pool) FROM walk WHERE n > 0)"""
COLS = "match_id, frame_idx, raw_id, candidate_id, round(similarity, 6) AS similarity, event, vetoed, matched, stable_id"


def raw_tracks(fx):
    v = fx.vectors
    text = F.when(F.col("vec_id") % 5 == 0, (F.col("label") % 2).cast("string"))
    number = F.struct((F.col("label") % 2).cast("string").alias("digits"), ((50 + F.col("vec_id") % 40) / 100.0).alias("conf"))
    shot = F.struct((80 + (F.col("vec_id") * 37) % 100).cast("double").alias("sharpness"), F.col("vec_id").alias("arrival"), "embedding")
    return v.select(
        "match_id", F.col("pos").alias("raw_id"), F.col("frame_idx").alias("first"), (F.col("frame_idx") + 5 + (F.col("vec_id") * 7) % 90).alias("last"), "embedding", text.alias("digits"),
        F.when(F.col("vec_id") % 4 != 0, F.col("vec_id") % 4 == 1).alias("verdict"), F.when(F.col("vec_id") % 3 == 0, number).alias("number"), F.array(shot).alias("shots"),
    )


def claims(fx, **sizes):
    return reid.claims(raw_tracks(fx), GAP, TTL, HIGH, LOW, **sizes)


def shown(rows):
    return rows.withColumn("similarity", F.round("similarity", 6)).select("match_id", "frame_idx", "raw_id", "candidate_id", "similarity", "event", "vetoed", "matched", "stable_id")


@query("i11_claims_along_time", f"WITH {CLAIMS} SELECT {COLS} FROM claimed")
def i11_time(fx):
    """Lost ids and who takes them over, exclusive over all frames."""
    return shown(claims(fx))


@query("i11_claims_along_time_pieces", like="i11_claims_along_time")
def i11_time_pieces(fx):
    """The same in pieces of 512 frames."""
    return shown(claims(fx, size=512, warmup=512))


SPANS = f"{CLAIMS}, spans AS (SELECT match_id, stable_id, frame_idx AS first, last, lead(frame_idx) OVER (PARTITION BY match_id, stable_id ORDER BY frame_idx) AS nxt FROM claimed), ends AS (SELECT match_id, max(last) + 1000 AS n_frames FROM raw GROUP BY match_id)"
EXPIRED = f"""{SPANS}, due AS (SELECT *, CAST(ceil((last + {TTL + 1}) / 30e0) * 30 AS BIGINT) AS chk FROM spans JOIN ends USING (match_id)),
expired AS (SELECT match_id, stable_id, last AS last_seen, CASE WHEN chk < n_frames AND (nxt IS NULL OR chk < nxt) THEN chk WHEN nxt IS NULL AND n_frames - last > {TTL} THEN n_frames END AS expired_at FROM due)"""


def expired(fx, decisions):
    raw = raw_tracks(fx)
    spans = decisions.select("match_id", "raw_id", "stable_id").join(raw.select("match_id", "raw_id", "first", "last"), ["match_id", "raw_id"])
    ends = raw.groupBy("match_id").agg((F.max("last") + 1000).alias("n_frames"))
    return reid.expired_ids(spans, ends, TTL)


@query("i12_expired_ids", f"WITH {EXPIRED} SELECT * FROM expired WHERE expired_at IS NOT NULL")
def i12_time(fx):
    """Ids forgotten after their last raw track ended."""
    return expired(fx, claims(fx))


DROPS = f"""{PAIRS}, links AS (SELECT match_id, a, b, min(frame_idx) AS frame_idx FROM pairs WHERE iou >= 75e-2 GROUP BY match_id, a, b),
ordered AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frame_idx, a, b) AS n FROM links),
merging AS (SELECT DISTINCT match_id, CAST(0 AS BIGINT) AS n, CAST(range(0, 12) AS BIGINT[]) AS goes, CAST(NULL AS BIGINT) AS frame_idx, CAST(NULL AS BIGINT) AS keep_id, CAST(NULL AS BIGINT) AS drop_id FROM links
UNION ALL SELECT match_id, n, list_transform(goes, lambda g: CASE WHEN g = greatest(x, y) THEN least(x, y) ELSE g END), frame_idx, least(x, y), greatest(x, y)
FROM (SELECT o.match_id, o.n, o.frame_idx, m.goes, m.goes[o.a + 1] AS x, m.goes[o.b + 1] AS y FROM merging m JOIN ordered o ON o.match_id = m.match_id AND o.n = m.n + 1) z),
drops AS (SELECT match_id, frame_idx, keep_id, drop_id FROM merging WHERE keep_id < drop_id)"""


def merges(fx):
    return reid.merge_events(tk.duplicate_pairs(fx.sql(CLOSE), 0.75))


@query("i13_merge_events", f"WITH {DROPS} SELECT * FROM drops")
def i13_events(fx):
    """Frame at which an id is merged into a smaller one."""
    return merges(fx)


@query("a14_full_log", f"""WITH {EXPIRED}, {DROPS}
SELECT match_id, frame_idx AS frame, event, raw_id, CASE WHEN event = 'reid_high_conf' THEN candidate_id END AS matched_stable_id, CASE WHEN event <> 'reid_high_conf' THEN candidate_id END AS candidate_stable_id, round(similarity, 6) AS similarity FROM claimed WHERE event IS NOT NULL
UNION ALL SELECT match_id, frame_idx, 'ocr_veto', raw_id, NULL, candidate_id, NULL FROM claimed WHERE vetoed
UNION ALL SELECT match_id, frame_idx, 'new_track', raw_id, stable_id, NULL, NULL FROM claimed WHERE NOT matched
UNION ALL SELECT match_id, frame_idx, 'duplicate_merge', NULL, keep_id, drop_id, NULL FROM drops
UNION ALL SELECT match_id, expired_at, 'gallery_expired', NULL, stable_id, NULL, NULL FROM expired WHERE expired_at IS NOT NULL""")
def a14_full(fx):
    """The whole decision log as CSV, read back."""
    decisions = claims(fx)
    path = writers.scratch(fx.spark, "reid-log")
    rows = reid.full_log(decisions, merges(fx), expired(fx, decisions)).withColumn("similarity", F.round("similarity", 6))
    writers.write_csv(rows.select("match_id", *writers.REID_FIELDS), path, order=["match_id", "frame", "raw_id"])
    types = {"frame": "bigint", "raw_id": "bigint", "matched_stable_id": "bigint", "candidate_stable_id": "bigint", "similarity": "double"}
    ddl = "match_id string, " + ", ".join(f"{f} {types.get(f, 'string')}" for f in writers.REID_FIELDS)
    return writers.read_csv(fx.spark, path, ddl).select("match_id", "frame", "event", "raw_id", "matched_stable_id", "candidate_stable_id", "similarity")


KEPT = "kept AS (SELECT match_id, track_id, keep_id FROM merged)"


@query("i13_merged_votes", f"""WITH {MERGED}, {KEPT}, v AS ({VOTES}), k AS (SELECT v.match_id, coalesce(keep_id, v.track_id) AS track_id, frame_idx, team_id FROM v LEFT JOIN kept USING (match_id, track_id)),
tally AS (SELECT match_id, track_id, team_id, count(*) AS n, min(frame_idx) AS since FROM k WHERE team_id IS NOT NULL GROUP BY ALL)
SELECT match_id, track_id, team_id FROM (SELECT *, row_number() OVER (PARTITION BY match_id, track_id ORDER BY n DESC, since) AS rn FROM tally) r WHERE rn = 1""")
def i13_votes(fx):
    """Team of every surviving id, from the counts of the ids merged into it."""
    return reid.voted_team(reid.merged_votes(reid.vote_counts(fx.sql(VOTES)), merged(fx)))


@query("i13_merged_gallery", f"""WITH {MERGED}, {KEPT}, k AS (SELECT c.match_id, coalesce(keep_id, c.track_id) AS track_id, arrival, sharpness FROM fx_crops c LEFT JOIN kept USING (match_id, track_id) WHERE crop_w >= 32 AND crop_h >= 32 AND sharpness >= 80)
SELECT match_id, track_id, arrival, sharpness, slot FROM (SELECT *, CAST(row_number() OVER (PARTITION BY match_id, track_id ORDER BY sharpness DESC, arrival) AS INT) AS slot FROM k) r WHERE slot <= 5""")
def i13_gallery(fx):
    """Gallery of every surviving id, from the galleries of the ids merged into it."""
    return reid.merged_gallery(tk.gallery(fx.crops), merged(fx)).select("match_id", "track_id", "arrival", "sharpness", "slot")


@query("i13_merged_numbers", f"""WITH {MERGED}, {KEPT}, r AS (SELECT c.match_id, c.track_id, coalesce(keep_id, c.track_id) AS keep_id, arrival, ocr_conf, regexp_replace(ocr_text, '[^0-9]', '', 'g') AS digits FROM fx_crops c LEFT JOIN kept USING (match_id, track_id) WHERE ocr_conf >= 75e-2)
SELECT match_id, keep_id AS track_id, digits, ocr_conf FROM (SELECT *, row_number() OVER (PARTITION BY match_id, keep_id ORDER BY ocr_conf DESC, track_id, arrival) AS rn FROM r WHERE digits <> '') x WHERE rn = 1""")
def i13_numbers(fx):
    """Number of every surviving id, from the numbers of the ids merged into it."""
    return reid.merged_numbers(tk.best_number(fx.crops), merged(fx))
