"""Minute counters and delivery bodies."""

from pyspark.sql import functions as F

from touchline.functions import counters as cnt
from touchline.operators import delivery, minutes as mn
from touchline.plans.registry import query

C = cnt.COUNTERS
CUM = ", ".join(f"CAST(sum(CASE WHEN superseded = 0 THEN {c} ELSE 0 END) OVER w AS BIGINT) AS {c}" for c in C)
WIRE = ", ".join(f"{c} AS {cnt.wire_key(c)}" for c in C)
BODY = "concat('{', " + ", ',', ".join(f"'\"{cnt.wire_key(c)}\":', {c}" for c in C) + ", '}')"
TOTALS = f"totals AS (SELECT match_id, half, minute, revision, {CUM} FROM fx_minute_stats WINDOW w AS (PARTITION BY match_id ORDER BY half, minute ROWS UNBOUNDED PRECEDING))"


@query("e7_cumulative_payload", f"WITH {TOTALS} SELECT match_id, half, minute, {WIRE}, {BODY} AS payload FROM totals")
def e7(fx):
    """Totals up to every minute, renamed, and as JSON."""
    return mn.payload(mn.cumulative(fx.minute_stats))


@query("d3_cumulative_read", "SELECT match_id, " + ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in C) +
       " FROM fx_minute_stats WHERE superseded = 0 AND (half < 2 OR (half = 2 AND minute <= 3)) GROUP BY match_id")
def d3(fx):
    """D3: totals up to one minute."""
    return mn.cumulative_read(fx.minute_stats, F.lit(2), F.lit(3))


@query("d4_build_payload", f"WITH s AS (SELECT match_id, half, minute, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in C)} FROM fx_minute_stats) SELECT match_id, half, minute, {WIRE}, {BODY} AS payload FROM s")
def d4(fx):
    """Counters under their delivered keys."""
    return mn.payload(fx.minute_stats)


@query("a3_scan_minutes", """SELECT m.match_id, m.half, m.minute, CAST(m.clip_duration_seconds AS DOUBLE) AS seconds, m.frames_team_a, t.ruleset
FROM fx_minute_stats m JOIN fx_matches t USING (match_id)""")
def a3(fx):
    """A3: stored minutes with their match."""
    rows = fx.minute_stats.join(fx.matches.select("match_id", "ruleset"), "match_id")
    return rows.select("match_id", "half", "minute", F.col("clip_duration_seconds").cast("double").alias("seconds"), "frames_team_a", "ruleset")


LABEL = "CASE WHEN k < 60 AND holder % 2 = 0 THEN 'team_a' WHEN k < 60 THEN 'team_b' WHEN k < 80 THEN 'loose' WHEN k < 90 THEN 'oof' ELSE 'odd' END"


@query("d1_label_counts", f"""WITH l AS (SELECT *, {LABEL} AS label FROM fx_frames)
SELECT match_id, half, minute, CAST(count(*) FILTER (label = 'team_a') AS INT) AS frames_team_a, CAST(count(*) FILTER (label = 'team_b') AS INT) AS frames_team_b,
 CAST(count(*) FILTER (label = 'loose') AS INT) AS frames_loose, CAST(count(*) FILTER (label IN ('oof', 'odd')) AS INT) AS frames_oof FROM l GROUP BY ALL""")
def d1(fx):
    """Frames per label and minute."""
    return mn.label_counts(fx.frames.withColumn("label", F.expr(LABEL)))


EVENT = "CASE k % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'interception' ELSE 'ball_lost' END"
TEAM = "CASE WHEN k % 5 = 0 THEN NULL ELSE k % 3 END"


@query("d2_event_counts", f"WITH e AS (SELECT *, {EVENT} AS kind, {TEAM} AS from_team FROM (SELECT *, event_id AS x FROM fx_frames) f) SELECT match_id, half, minute, " + ", ".join(
    f"CAST(count(*) FILTER (kind = '{k}' AND from_team = {t}) AS INT) AS {n}_{s}"
    for k, n in (("completed", "passes_completed"), ("interception", "interceptions"), ("ball_lost", "ball_lost")) for t, s in ((0, "team_a"), (1, "team_b"))
) + " FROM e GROUP BY ALL")
def d2(fx):
    """Events per kind and passing team."""
    return mn.event_counts(fx.frames.withColumns({"kind": F.expr(EVENT), "from_team": F.expr(TEAM)}))


@query("d7_possession_share", """SELECT match_id, half, minute, CASE WHEN a + b = 0 THEN 0 ELSE round(100e0 * a / (a + b), 6) END AS possession_a,
 CASE WHEN a + b = 0 THEN 0 ELSE round(100e0 * b / (a + b), 6) END AS possession_b, round(100e0 * l / greatest(1, a + b + l + o), 6) AS loose_share,
 round(100e0 * o / greatest(1, a + b + l + o), 6) AS oof_share
FROM (SELECT match_id, half, minute, frames_team_a AS a, frames_team_b AS b, frames_loose AS l, frames_oof AS o FROM fx_minute_stats) s""")
def d7(fx):
    """Possession over team frames; loose and oof over all."""
    cols = ["possession_a", "possession_b", "loose_share", "oof_share"]
    return mn.possession(fx.minute_stats).select("match_id", "half", "minute", *[F.round(c, 6).alias(c) for c in cols])


@query("d8_possession_with_loose", """SELECT match_id, half, minute, CASE WHEN a + b + l = 0 THEN 0 ELSE round(100e0 * a / (a + b + l), 6) END AS possession_with_loose_a,
 CASE WHEN a + b + l = 0 THEN 0 ELSE round(100e0 * b / (a + b + l), 6) END AS possession_with_loose_b
FROM (SELECT match_id, half, minute, frames_team_a AS a, frames_team_b AS b, frames_loose AS l FROM fx_minute_stats) s""")
def d8(fx):
    """Possession over team and loose frames."""
    cols = ["possession_with_loose_a", "possession_with_loose_b"]
    return mn.possession(fx.minute_stats).select("match_id", "half", "minute", *[F.round(c, 6).alias(c) for c in cols])


@query("d9_pass_accuracy", "SELECT match_id, half, minute, " + ", ".join(
    f"CASE WHEN p_{t} + i_{t} + l_{t} = 0 THEN 0 ELSE round(100e0 * p_{t} / (p_{t} + i_{t} + l_{t}), 6) END AS accuracy_team_{t}, round(100e0 * p_{t} / greatest(1, p_{t} + i_{t}), 6) AS overlay_accuracy_team_{t}"
    for t in "ab") + " FROM (SELECT *, " + ", ".join(f"passes_completed_team_{t} AS p_{t}, interceptions_team_{t} AS i_{t}, ball_lost_team_{t} AS l_{t}" for t in "ab") + " FROM fx_minute_stats) s")
def d9(fx):
    """Both pass accuracies."""
    cols = [f"{p}_{t}" for p in ("accuracy", "overlay_accuracy") for t in ("team_a", "team_b")]
    return mn.pass_rates(fx.minute_stats).select("match_id", "half", "minute", *[F.round(c, 6).alias(c) for c in cols])


@query("d10_pass_density", "SELECT match_id, half, minute, " + ", ".join(
    f"CASE WHEN clip_duration_seconds = 0 THEN 0 ELSE round(60e0 * passes_completed_team_{t} / CAST(clip_duration_seconds AS DOUBLE), 6) END AS density_team_{t}" for t in "ab") + " FROM fx_minute_stats")
def d10(fx):
    """Passes per minute of play."""
    return mn.pass_rates(fx.minute_stats).select("match_id", "half", "minute", *[F.round(c, 6).alias(c) for c in ("density_team_a", "density_team_b")])


@query("d11_pass_summary", f"""WITH e AS (SELECT match_id, {EVENT} AS kind, {TEAM} AS from_team FROM fx_frames)
SELECT match_id, CAST(from_team AS INT) AS team_id, count(*) FILTER (kind = 'completed') AS successful, count(*) FILTER (kind = 'interception') AS inaccurate
FROM e WHERE from_team IN (0, 1) GROUP BY ALL""")
def d11(fx):
    """Successful and inaccurate passes per team."""
    events = fx.frames.select("match_id", F.expr(EVENT).alias("kind"), F.expr(TEAM).alias("team_id"))
    return mn.pass_summary(events)


SUM_ALL = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in C)


@query("d32_whole_match", f"SELECT match_id, CAST(1 AS INT) AS half, CAST(1 AS INT) AS minute, 0e0 AS clip_duration_seconds, {SUM_ALL} FROM fx_minute_stats GROUP BY match_id")
def d32(fx):
    """One row for a whole match."""
    return mn.whole_match(fx.minute_stats)


CORRECTIONS = """SELECT match_id, half, minute, CASE WHEN frames_oof % 3 = 0 THEN 'drop' WHEN frames_oof % 3 = 1 THEN 'flip_to' ELSE 'none' END AS kind,
 CAST(frames_loose % 2 AS INT) AS team_id, CAST(passes_completed_team_a * 4 - 2 AS INT) AS frames FROM fx_minute_stats WHERE frames_team_a >= 8"""


@query("c4_prior_corrections", f"""WITH c AS ({CORRECTIONS}), j AS (SELECT m.match_id, m.half, m.minute, frames_team_a AS a, frames_team_b AS b, frames_oof AS o, revision, c.kind, c.team_id AS t, c.frames AS n
 FROM fx_minute_stats m LEFT JOIN c ON c.match_id = m.match_id AND c.half = m.half AND c.minute = m.minute AND c.kind <> 'none' AND c.frames > 0)
SELECT match_id, half, minute, CAST(a + CASE WHEN kind = 'flip_to' AND t = 0 THEN least(n, b) WHEN kind = 'flip_to' OR (kind = 'drop' AND t = 0) THEN -least(n, a) ELSE 0 END AS INT) AS frames_team_a,
 CAST(b + CASE WHEN kind = 'flip_to' AND t = 1 THEN least(n, a) WHEN kind = 'flip_to' OR (kind = 'drop' AND t = 1) THEN -least(n, b) ELSE 0 END AS INT) AS frames_team_b,
 CAST(o + CASE WHEN kind = 'drop' AND t = 0 THEN least(n, a) WHEN kind = 'drop' THEN least(n, b) ELSE 0 END AS INT) AS frames_oof,
 CAST(revision + CASE WHEN n IS NULL THEN 0 ELSE 1 END AS INT) AS revision FROM j""")
def c4(fx):
    """C4: corrections applied to earlier minutes."""
    rows = mn.apply_corrections(fx.minute_stats, fx.sql(CORRECTIONS))
    return rows.select("match_id", "half", "minute", "frames_team_a", "frames_team_b", "frames_oof", "revision")


SWAPPED = ", ".join(f"CASE WHEN m.team_a_cluster_id = 1 THEN s.{c[:-1] + ('b' if c[-1] == 'a' else 'a') if '_team_' in c else c} ELSE s.{c} END AS {c}" for c in C)


@query("c5_orientation", f"SELECT s.match_id, s.half, s.minute, {SWAPPED} FROM fx_minute_stats s JOIN fx_matches m USING (match_id)")
def c5(fx):
    """Sides swapped where team a is cluster 1."""
    rows = fx.minute_stats.join(fx.matches.select("match_id", "team_a_cluster_id"), "match_id", "left")
    return mn.orient_rows(rows).select("match_id", "half", "minute", *C)


@query("e12_previous_orientation", """SELECT match_id, half, minute, lag(team_a_cluster_id) OVER w AS previous_cluster_id, lag(half) OVER w AS previous_half, lag(minute) OVER w AS previous_minute
FROM fx_processed WINDOW w AS (PARTITION BY match_id ORDER BY half, minute)""")
def e12(fx):
    """Orientation the row before was written under."""
    rows = mn.with_previous_orientation(fx.processed)
    return rows.select("match_id", "half", "minute", "previous_cluster_id", "previous_half", "previous_minute")


WRITES = """SELECT match_id, CAST(1 + half % 2 AS INT) AS half, minute, clip_duration_seconds, frames_team_b AS frames_team_a, frames_team_a AS frames_team_b, frames_loose, frames_oof,
 passes_completed_team_a, passes_completed_team_b, interceptions_team_a, interceptions_team_b, ball_lost_team_a, ball_lost_team_b, CAST(minute * 2 + 0 AS BIGINT) AS write_seq FROM fx_minute_stats
UNION ALL SELECT match_id, CAST(1 + half % 2 AS INT) AS half, minute, clip_duration_seconds, frames_team_a, frames_oof AS frames_team_b, frames_loose, frames_team_b AS frames_oof,
 passes_completed_team_a, passes_completed_team_b, interceptions_team_a, interceptions_team_b, ball_lost_team_a, ball_lost_team_b, CAST(minute * 2 + 1 AS BIGINT) AS write_seq FROM fx_minute_stats WHERE frames_oof > 3"""


@query("a7_upsert_minutes", f"""WITH w AS ({WRITES}), latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, half, minute ORDER BY write_seq DESC) AS rn FROM w) x WHERE rn = 1)
SELECT coalesce(n.match_id, o.match_id) AS match_id, coalesce(n.half, o.half) AS half, coalesce(n.minute, o.minute) AS minute, {", ".join(f"coalesce(n.{c}, o.{c}) AS {c}" for c in C)},
 coalesce(o.revision, 0) AS revision, coalesce(o.superseded, 0) AS superseded
FROM fx_minute_stats o FULL JOIN latest n ON n.match_id = o.match_id AND n.half = o.half AND n.minute = o.minute""")
def a7(fx):
    """Last write of a minute wins, its revision and flag stay."""
    return mn.upsert(fx.minute_stats, fx.sql(WRITES)).select("match_id", "half", "minute", *C, "revision", "superseded")


RESETS = """SELECT match_id, CAST(1 + mno % 2 AS INT) AS upto_half, CAST(3 + mno % 5 AS INT) AS upto_minute FROM fx_matches WHERE mno % 4 < 3"""


@query("d30_superseded_count", f"""WITH r AS ({RESETS}), t AS (SELECT match_id, half, minute, superseded FROM fx_minute_stats UNION ALL SELECT match_id, half, minute, 0 FROM fx_frames)
SELECT t.match_id, count(*) AS n FROM t JOIN r USING (match_id) WHERE superseded = 0 AND (half < upto_half OR (half = upto_half AND minute <= upto_minute)) GROUP BY t.match_id""")
def d30(fx):
    """Rows a reset newly flags in the minute and event tables."""
    both = [fx.minute_stats.select(*mn.CLIP, "superseded"), fx.frames.select(*mn.CLIP, F.lit(0).alias("superseded"))]
    return mn.superseded_count(both, fx.sql(RESETS))


@query("e11_supersede", """WITH g AS (SELECT match_id, half, minute, wanted_generation, max(wanted_generation) OVER (PARTITION BY match_id ORDER BY half, minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had, lag(half) OVER w AS ph, lag(minute) OVER w AS pm
  FROM fx_processed WINDOW w AS (PARTITION BY match_id ORDER BY half, minute)),
r AS (SELECT match_id, max(ph * 1000 + pm) AS upto FROM g WHERE wanted_generation > coalesce(had, 1) AND ph IS NOT NULL GROUP BY match_id)
SELECT m.match_id, m.half, m.minute, CAST(CASE WHEN m.half * 1000 + m.minute <= r.upto THEN 1 ELSE m.superseded END AS INT) AS superseded
FROM fx_minute_stats m LEFT JOIN r USING (match_id)""")
def e11(fx):
    """A clip under a higher generation flags all rows before it."""
    from touchline.operators import ingest
    return mn.supersede(fx.minute_stats, ingest.reset_points(fx.processed)).select("match_id", "half", "minute", "superseded")


@query("d31_match_progress", """SELECT match_id, arg_max(half, write_seq) AS last_half, arg_max(minute, write_seq) AS last_minute
FROM (SELECT match_id, half, minute, arrival AS write_seq FROM fx_clips WHERE minute IS NOT NULL) c GROUP BY match_id""")
def d31(fx):
    """Last written clip, not the highest."""
    return mn.match_progress(fx.clips.filter("minute IS NOT NULL").withColumnRenamed("arrival", "write_seq"))


@query("a8_event_log", f"""SELECT match_id, half, minute, frame_idx, CASE k % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'interception' ELSE 'ball_lost' END AS kind, CAST({TEAM} AS INT) AS from_team, 0 AS superseded FROM fx_frames""")
def a8(fx):
    """Events appended to a log table, read back."""
    from touchline.sources import writers
    rows = fx.frames.withColumns({"kind": cnt.event_kind(F.expr(EVENT)), "from_team": F.expr(TEAM).cast("int")})
    path = writers.scratch(fx.spark, "event-log")
    return writers.append_events(rows.select("match_id", "half", "minute", "frame_idx", "kind", "from_team"), path)


@query("a9_outbox", f"WITH {TOTALS} SELECT match_id, half, minute, {BODY} AS payload, 'pending' AS status, 0 AS attempts FROM totals")
def a9(fx):
    """One pending delivery per minute with its JSON body."""
    return delivery.outbox(mn.payload(mn.cumulative(fx.minute_stats)))


@query("h19_payload_fields", f"SELECT match_id, half, minute, CAST(frames_team_a AS BIGINT) AS frames_a, CAST(frames_team_b AS BIGINT) AS frames_b, CAST(ball_lost_team_b AS BIGINT) AS ball_lost_b FROM fx_minute_stats")
def h19(fx):
    """Fields read back from the JSON body."""
    body = delivery.read_payload(mn.payload(fx.minute_stats))
    return body.select("match_id", "half", "minute", "body.frames_a", "body.frames_b", "body.ball_lost_b")


@query("a10_post_processing", f"""WITH w AS (SELECT match_id, half, minute, CASE WHEN minute % 2 = 0 THEN '' WHEN minute % 3 = 0 THEN NULL ELSE concat('v', minute) END AS video, concat('r', minute) AS row_path,
 half * 1000 + minute AS write_seq, {", ".join(C)} FROM fx_minute_stats), latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY write_seq DESC) AS rn FROM w) x WHERE rn = 1)
SELECT l.match_id, m.team_a_name, m.team_b_colour, coalesce(nullif(video, ''), row_path) AS video_blob_path, {", ".join("l." + c for c in C)} FROM latest l JOIN fx_matches m USING (match_id)""")
def a10(fx):
    """A10: last whole-match write per match."""
    video = F.when(F.col("minute") % 2 == 0, "").when(F.col("minute") % 3 == 0, None).otherwise(F.concat(F.lit("v"), F.col("minute").cast("string")))
    writes = fx.minute_stats.withColumns({"video_blob_path": video, "clip_blob_path": F.concat(F.lit("r"), F.col("minute").cast("string")),
                                          "write_seq": F.col("half") * 1000 + F.col("minute")})
    writes = writes.join(fx.matches.select("match_id", "team_a_name", "team_b_colour"), "match_id")
    return mn.latest_post_processing(writes, ["team_a_name", "team_b_colour"]).select("match_id", "team_a_name", "team_b_colour", "video_blob_path", *C)


@query("f3_pending_order", """SELECT match_id, half, minute, row_number() OVER (PARTITION BY match_id ORDER BY half, minute) AS position FROM fx_outbox WHERE status = 'pending'""")
def f3(fx):
    """pending deliveries of a match in order."""
    return delivery.pending(fx.outbox).select("match_id", "half", "minute", "position")


LEDGER = """WITH answers AS (SELECT * FROM fx_answers WHERE {}), tries AS (SELECT o.match_id, o.half, o.minute, o.attempts, a.try_no, a.http_status FROM fx_outbox o LEFT JOIN answers a
 ON a.match_id = o.match_id AND a.half = o.half AND a.minute = o.minute WHERE o.status = 'pending'),
stops AS (SELECT match_id, half, minute, min(try_no) FILTER (http_status BETWEEN 200 AND 299 OR http_status = 401) AS stop, max(attempts) AS had, count(DISTINCT try_no) AS made FROM tries GROUP BY ALL)
SELECT s.match_id, s.half, s.minute, CASE WHEN t.http_status BETWEEN 200 AND 299 THEN 'sent' WHEN stop IS NULL AND made < 3 THEN 'pending' ELSE 'failed' END AS status, CAST(had + coalesce(stop, made) AS INT) AS attempts
FROM stops s LEFT JOIN tries t ON t.match_id = s.match_id AND t.half = s.half AND t.minute = s.minute AND t.try_no = s.stop"""


ANSWERED = "minute % 4 <> 1 AND (minute % 4 <> 2 OR try_no < 3)"


@query("i15_open_deliveries", LEDGER.format(ANSWERED))
def i15_open(fx):
    """The same where some deliveries have had fewer tries, or none."""
    return delivery.ledger(fx.outbox, fx.answers.filter(ANSWERED))


@query("i15_delivery_ledger", LEDGER.format("true"))
def i15(fx):
    """Outcome of every pending delivery from its answers."""
    return delivery.ledger(fx.outbox, fx.answers)
