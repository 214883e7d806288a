"""Uploads, messages, metadata, operations."""

from pyspark.sql import functions as F

from touchline.operators import ingest
from touchline.operators.joins import dealt
from touchline.plans.registry import query
from touchline.plans.scalar_queries import NORMAL
from touchline.sources import logs, writers
from touchline.operators.scans import time_bucket, minute_bucket


@query("a4_parse_messages", """WITH j AS (SELECT message_id, body, NOT json_valid(body) AS poison, CASE WHEN json_valid(body) THEN body ELSE '{}' END AS b FROM fx_messages),
v AS (SELECT message_id, poison, b->>'match_id' AS match_id, b->>'blob_path' AS blob_path, b->>'kind' AS kind, TRY_CAST(b->>'half' AS INT) AS half, TRY_CAST(b->>'minute' AS INT) AS minute,
 TRY_CAST(b->>'clip_duration_seconds' AS DOUBLE) AS s, b->>'team_a_name' AS team_a_name, b->>'team_b_colour' AS team_b_colour, TRY_CAST(b->>'ordering_retries' AS INT) AS r FROM j)
SELECT message_id, poison, match_id, blob_path, CASE WHEN NOT poison THEN coalesce(kind, 'clip') END AS kind, CASE WHEN NOT poison THEN coalesce(half, 0) END AS half,
 CASE WHEN NOT poison THEN coalesce(minute, 0) END AS minute, CASE WHEN NOT poison THEN coalesce(s, 60e0) END AS clip_duration_seconds, team_a_name, team_b_colour,
 CASE WHEN NOT poison THEN coalesce(r, 0) END AS ordering_retries FROM v""")
def a4(fx):
    """A4: queue bodies parsed with defaults, broken ones marked."""
    return ingest.parse_messages(fx.messages).select("message_id", "poison", "match_id", "blob_path", "kind", "half", "minute", "clip_duration_seconds",
                                                     "team_a_name", "team_b_colour", "ordering_retries")


@query("a6_keypoint_log", "SELECT match_id, frame_idx, idx, px, py, conf FROM fx_keypoints")
def a6(fx):
    """Keypoint log written as JSON and read back."""
    point = F.struct("idx", "px", "py", "conf")
    log = fx.keypoints.groupBy("match_id", F.col("frame_idx").alias("frame")).agg(F.sort_array(F.collect_list(point)).alias("keypoints"))
    path = writers.scratch(fx.spark, "keypoint-log")
    log.write.json(path)
    return logs.keypoints(logs.read_keypoint_log(fx.spark, path))


@query("a12_choose_matches", """SELECT match_id, rule FROM (
SELECT match_id, 'args' AS rule FROM fx_matches WHERE match_id IN ('m1', 'm3') UNION ALL SELECT match_id, 'list' FROM fx_matches WHERE match_id IN ('m2', 'm5')
UNION ALL SELECT match_id, 'all' FROM fx_matches) x""")
def a12(fx):
    """Matches to export by argument, by list, or all."""
    chosen = {"args": ingest.choose_matches(fx.matches, ["m1", "m3"], "m2"), "list": ingest.choose_matches(fx.matches, [], " m2,, m5 ,nope"),
              "all": ingest.choose_matches(fx.matches)}
    out = [df.select("match_id", F.lit(rule).alias("rule")) for rule, df in chosen.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


SIDECARS = """SELECT match_id, CASE WHEN mno % 4 = 0 THEN concat('{"fit_generation": ', CAST(mno + 1 AS VARCHAR(20)), ', "team_a_cluster_id": 1}')
 WHEN mno % 4 = 1 THEN '{"team_a_cluster_id": 0}' ELSE '{"fit_gen' END AS meta FROM fx_matches WHERE mno % 4 <> 3"""


@query("a15_fit_sidecar", f"""WITH s AS ({SIDECARS}), v AS (SELECT match_id, CASE WHEN json_valid(meta) THEN meta ELSE '{{}}' END AS j FROM s)
SELECT m.match_id, coalesce(TRY_CAST(j->>'fit_generation' AS INT), 1) AS fit_generation, TRY_CAST(j->>'team_a_cluster_id' AS INT) AS team_a_cluster_id
FROM fx_matches m LEFT JOIN v USING (match_id)""")
def a15(fx):
    """Stored fit, with defaults for missing or broken sidecars."""
    return ingest.read_fit_meta(fx.matches, fx.sql(SIDECARS))


VIDEOS = "SELECT match_id, sum(CAST(clip_duration_seconds AS DOUBLE)) + count(*) / 8e0 AS duration_s FROM fx_minute_stats GROUP BY match_id"


@query("a17_split_video", f"""WITH v AS ({VIDEOS}), c AS (SELECT match_id, duration_s, CAST(unnest(range(0, CAST(ceil(duration_s / 60) AS BIGINT))) AS INT) AS clip FROM v)
SELECT match_id, clip, clip * 60e0 AS start_s, least(60e0, duration_s - clip * 60e0) AS length_s FROM c""")
def a17(fx):
    """Clips of 60 seconds."""
    return ingest.split_video(fx.sql(VIDEOS))


FIELDS = ingest.TEAM_FIELDS
EMPTY = "list_aggregate(list_sort(list_filter([" + ", ".join(f"CASE WHEN coalesce(trim({f}), '') = '' THEN '{f}' END" for f in FIELDS) + "], lambda x: x IS NOT NULL)), 'string_agg', ', ')"


@query("b12_upload_checks", f"""WITH e AS (SELECT *, coalesce({EMPTY}, '') AS empty FROM (SELECT * REPLACE (
 CASE WHEN k % 2 = 0 THEN 'A' ELSE team_a_name END AS team_a_name, CASE WHEN k % 2 = 0 THEN 'B' ELSE team_b_name END AS team_b_name,
 coalesce(team_a_colour, 'red') AS team_a_colour, coalesce(team_b_colour, 'blue') AS team_b_colour, coalesce(team_a_gk_colour, ' ') AS team_a_gk_colour, coalesce(team_b_gk_colour, 'lime') AS team_b_gk_colour,
 CASE WHEN k % 4 < 2 THEN 'grey' ELSE team_a_gk_colour END AS team_a_gk_colour) FROM (SELECT r.*, v.k FROM fx_requests r JOIN fx_ev v USING (event_id)) q) p),
c AS (SELECT *, CASE WHEN content_type NOT IN ('video/mp4', 'application/octet-stream') THEN 415 WHEN size_bytes > 2147483648 THEN 413 WHEN clip_duration_seconds <= 0 THEN 422
 WHEN half < 1 THEN 422 WHEN minute < 1 THEN 422 WHEN empty <> '' THEN 422 WHEN ruleset NOT IN ('classic', 'futsal') THEN 422 ELSE 202 END AS status FROM e)
SELECT event_id, status, CASE WHEN content_type NOT IN ('video/mp4', 'application/octet-stream') THEN concat('unsupported content type: ', content_type) WHEN size_bytes > 2147483648 THEN 'clip exceeds 2.0 GB cap'
 WHEN clip_duration_seconds <= 0 THEN 'clip_duration_seconds must be > 0' WHEN half < 1 THEN 'half must be >= 1' WHEN minute < 1 THEN 'minute must be >= 1'
 WHEN empty <> '' THEN concat('required field(s) empty: ', empty) WHEN ruleset NOT IN ('classic', 'futsal') THEN concat('unknown ruleset ', ruleset) END AS reason FROM c""".replace(
    "coalesce(team_a_gk_colour, ' ') AS team_a_gk_colour, ", ""))
def b12(fx):
    """Accepted and rejected uploads, first failure wins."""
    r = fx.requests.join(dealt(fx.ev.select("event_id", "k")), "event_id")
    even = F.col("k") % 2 == 0
    filled = r.withColumns({"team_a_name": F.when(even, "A").otherwise(F.col("team_a_name")), "team_b_name": F.when(even, "B").otherwise(F.col("team_b_name")),
                            "team_a_colour": F.coalesce("team_a_colour", F.lit("red")), "team_b_colour": F.coalesce("team_b_colour", F.lit("blue")),
                            "team_a_gk_colour": F.when(F.col("k") % 4 < 2, "grey").otherwise(F.col("team_a_gk_colour")),
                            "team_b_gk_colour": F.coalesce("team_b_gk_colour", F.lit("lime"))})
    return ingest.validate_uploads(filled).select("event_id", "status", "reason")


@query("b18_complete_specs", """SELECT match_id, 'team' AS spec FROM fx_matches WHERE nullif(team_a_name, '') IS NOT NULL AND nullif(team_b_name, '') IS NOT NULL AND nullif(team_a_colour, '') IS NOT NULL AND nullif(team_b_colour, '') IS NOT NULL
UNION ALL SELECT match_id, 'gk' FROM fx_matches WHERE nullif(team_a_gk_colour, '') IS NOT NULL AND nullif(team_b_gk_colour, '') IS NOT NULL""")
def b18(fx):
    """Matches with complete team and goalkeeper data."""
    team = ingest.complete_specs(fx.matches, ["team_a_name", "team_b_name", "team_a_colour", "team_b_colour"])
    gk = ingest.complete_specs(fx.matches, ["team_a_gk_colour", "team_b_gk_colour"])
    return team.select("match_id", F.lit("team").alias("spec")).unionByName(gk.select("match_id", F.lit("gk").alias("spec")))


@query("b21_poison_routing", "SELECT event_id, CASE WHEN dequeue_count > 3 THEN 'poison' ELSE 'kept' END AS target FROM fx_clips")
def b21(fx):
    """Clips delivered too often."""
    kept, poison = ingest.route_poison(fx.clips)
    return kept.select("event_id", F.lit("kept").alias("target")).unionByName(poison.select("event_id", F.lit("poison").alias("target")))


@query("c7_drop_processed", """WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, half, minute ORDER BY arrival) AS rn FROM fx_clips WHERE minute IS NOT NULL) x WHERE rn = 1)
SELECT match_id, half, minute, event_id, arrival FROM f WHERE NOT EXISTS (SELECT 1 FROM fx_minute_stats m WHERE m.match_id = f.match_id AND m.half = f.half AND m.minute = f.minute)""")
def c7(fx):
    """First arrival of clips without a stored minute."""
    done = ingest.drop_processed(fx.clips.filter("minute IS NOT NULL"), fx.minute_stats)
    return done.select("match_id", "half", "minute", "event_id", "arrival")


@query("g4_dedup_clips", """SELECT match_id, half, minute, arrival FROM (SELECT *, row_number() OVER (PARTITION BY match_id, half, minute ORDER BY arrival) AS rn FROM fx_clips WHERE minute IS NOT NULL) x WHERE rn = 1""")
def g4(fx):
    """One clip per (match, half, minute), the first to arrive."""
    return fx.clips.filter("minute IS NOT NULL").groupBy("match_id", "half", "minute").agg(F.min("arrival").alias("arrival"))


@query("c14_generation_check", """SELECT match_id, half, minute, greatest(1, coalesce(had, 1)) AS session_generation, wanted_generation > greatest(1, coalesce(had, 1)) AS reset FROM (
SELECT *, max(wanted_generation) OVER (PARTITION BY match_id ORDER BY half, minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had FROM fx_processed) p""")
def c14(fx):
    """C14: clips that want a newer fit than their session holds."""
    return ingest.generation_resets(fx.processed).select("match_id", "half", "minute", "session_generation", "reset")


@query("d27_queue_metrics", """WITH m AS (SELECT CASE WHEN c.dequeue_count > 3 THEN 'poison' WHEN c.minute IS NULL THEN 'queued' ELSE 'done' END AS state, ts AS heartbeat FROM fx_clips c)
SELECT count(*) FILTER (state = 'queued') AS queue_depth, count(*) FILTER (state = 'poison') AS poison_depth, count(*) FILTER (state = 'queued') * 60 AS seconds_behind_live,
 epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(heartbeat))) < 300 AS worker_alive FROM m""")
def d27(fx):
    """Queue depth, lag and worker health."""
    state = F.when(F.col("dequeue_count") > 3, "poison").when(F.col("minute").isNull(), "queued").otherwise("done")
    manifest = fx.clips.select(state.alias("state"), F.col("ts").alias("heartbeat"))
    return ingest.queue_metrics(manifest, F.lit("2024-01-31 00:00:00").cast("timestamp"))


@query("d28_stage_timing", """WITH t AS (SELECT match_id, half, minute, 'tracker' AS stage, k + 25e-2 AS ms FROM fx_frames UNION ALL SELECT match_id, half, minute, 'carrier', k / 4e0 FROM fx_frames WHERE k < 85)
SELECT match_id, half, minute, stage, count(*) AS frames, round(sum(ms) / count(*), 6) AS ms_per_frame FROM t GROUP BY ALL""")
def d28(fx):
    """Milliseconds per frame and stage of every clip."""
    f = fx.frames
    rows = f.select("match_id", "half", "minute", F.lit("tracker").alias("stage"), (F.col("k") + 0.25).alias("ms"))
    rows = rows.unionByName(f.filter("k < 85").select("match_id", "half", "minute", F.lit("carrier").alias("stage"), (F.col("k") / 4.0).alias("ms")))
    return ingest.stage_timing(rows).withColumn("ms_per_frame", F.round("ms_per_frame", 6))


@query("e2_claim_minutes", """SELECT event_id, match_id, half, coalesce(minute, CAST(row_number() OVER (PARTITION BY match_id, half, minute IS NULL ORDER BY arrival) AS INT)) AS minute, minute IS NULL AS claimed FROM fx_clips""")
def e2(fx):
    """Next minute number for clips that bring none."""
    return ingest.claim_minutes(fx.clips).select("event_id", "match_id", "half", "minute", "claimed")


@query("e3_ordering_guard", """WITH p AS (SELECT *, lag(half) OVER w AS lh, lag(minute) OVER w AS lm FROM fx_processed WINDOW w AS (PARTITION BY match_id ORDER BY half, minute))
SELECT match_id, half, minute, CASE WHEN lm IS NULL THEN NOT (half = 1 AND minute = 1) ELSE NOT ((half = lh AND minute = lm + 1) OR (half = lh + 1 AND minute = 1)) END AS gap FROM p""")
def e3(fx):
    """Clips that do not follow the one before."""
    return ingest.ordering_guard(fx.processed, minute_bucket(), ["half", "minute"]).select("match_id", "half", "minute", "gap")


def metadata_sql(where, live):
    last = "last_value({c} IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND {e})"
    cols = ingest.COLOURS
    old = ", ".join(f"{last.format(c=c, e='1 PRECEDING')} AS old_{c}, {last.format(c=c, e='CURRENT ROW')} AS now_{c}" for c in cols)
    diff = " OR ".join(
        f"(old_{c} IS NOT NULL AND {c} IS NOT NULL AND {NORMAL.format(c=f'old_{c}')} IS DISTINCT FROM {NORMAL.format(c=c)})" for c in cols)
    names = ", ".join(
        f"coalesce(last_value(CASE WHEN request = 'reset' THEN {c} END IGNORE NULLS) OVER w, first_value({c} IGNORE NULLS) OVER w) AS {c}" for c in ingest.NAMES)
    return f"""WITH src AS (SELECT *, min(CASE WHEN request = 'clip' THEN seq END) OVER (PARTITION BY match_id) AS born FROM fx_requests WHERE {where}),
live AS (SELECT * FROM src WHERE seq >= born), s AS (SELECT *, {old} FROM live), b AS (SELECT *, CASE WHEN request = 'reset' OR {diff} THEN 1 ELSE 0 END AS bump FROM s)
SELECT match_id, seq, {names}, {", ".join(f"now_{c} AS {c}" for c in cols)}, CAST(1 + sum(bump) OVER w AS INT) AS fit_generation FROM b
WINDOW w AS (PARTITION BY match_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"""


@query("e9_metadata_evolution", metadata_sql("request = 'clip'", True))
def e9(fx):
    """Metadata and generation after every upload."""
    return ingest.evolve_metadata(fx.requests.filter("request = 'clip'"))


@query("e10_manual_reset", metadata_sql("true", True))
def e10(fx):
    """The same with manual resets among the uploads."""
    ok = fx.requests.filter((F.col("request") != "reset") | (ingest.blank_fields(fx.requests) == ""))
    return ingest.evolve_metadata(ok)


@query("i9_idle_sessions", """WITH g AS (SELECT match_id, event_id, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY match_id ORDER BY ts)) AS gap FROM fx_clips)
SELECT match_id, event_id, CAST(sum(CASE WHEN gap IS NULL OR gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY ts) AS BIGINT) AS session FROM g""")
def i9(fx):
    """Sessions end after 1800 idle seconds."""
    return ingest.idle_sessions(fx.clips, time_bucket("ts")).select("match_id", "event_id", "session")
