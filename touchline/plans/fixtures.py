"""Match tables derived from the ``events`` and ``embeddings`` tables.

``TEXT`` holds every table as SQL that both Spark and the checking engine run.
Tables that need a window over a match are built in Spark with split scans.
``{each:i:0:12}`` stands for one row per integer.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import scans
from touchline.session import durable

TEXT: dict[str, str] = {}

TEXT["fx_ev"] = """
SELECT event_id, user_id, CAST(floor(user_id / 12) AS BIGINT) AS mno,
  concat('m', CAST(CAST(floor(user_id / 12) AS BIGINT) AS VARCHAR(20))) AS match_id,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, event_type, value, ts,
  CAST(row_number() OVER (PARTITION BY CAST(floor(user_id / 12) AS BIGINT) ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_idx
FROM events"""

TEXT["fx_frames"] = """
SELECT match_id, mno, event_id, frame_idx, k, ts,
  first_value(user_id) OVER (PARTITION BY match_id, CAST(floor(frame_idx / 6) AS BIGINT) ORDER BY frame_idx) % 12 AS holder,
  CAST(1 + CASE WHEN frame_idx >= 450 THEN 1 ELSE 0 END AS INT) AS half,
  CAST(1 + floor((frame_idx - CASE WHEN frame_idx >= 450 THEN 450 ELSE 0 END) / 30) AS INT) AS minute
FROM fx_ev"""

TEXT["fx_players"] = """
SELECT f.match_id, f.frame_idx, t.track_id, CAST(t.track_id % 2 AS INT) AS team_id,
  (f.mno * 131 + t.track_id * 211 + f.frame_idx * 7) % 1200 AS x1,
  (f.mno * 57 + t.track_id * 97 + f.frame_idx * 3) % 560 AS y1,
  (f.mno * 131 + t.track_id * 211 + f.frame_idx * 7) % 1200 + 40 AS x2,
  (f.mno * 57 + t.track_id * 97 + f.frame_idx * 3) % 560 + 100 + (f.event_id + t.track_id) % 60 AS y2,
  ((f.event_id * 13 + t.track_id * 29) % 100) / 100e0 AS confidence
FROM fx_frames f {each:track_id:0:11}"""

TEXT["fx_balls"] = """
SELECT f.match_id, f.frame_idx, t.ball_no,
  CAST(floor((f.x1 + f.x2) / 2) AS BIGINT) + (f.k % 40) * (1 + t.ball_no * 6) - 10 AS cx, f.y2 - (f.k % 25) AS cy,
  ((f.event_id * 17 + t.ball_no * 41) % 100) / 100e0 AS confidence
FROM (SELECT g.match_id, g.frame_idx, g.event_id, g.k, p.x1, p.x2, p.y2 FROM fx_frames g JOIN fx_players p
      ON p.match_id = g.match_id AND p.frame_idx = g.frame_idx AND p.track_id = g.holder
      WHERE g.k < 85) f {each:ball_no:0:1}"""

TEXT["fx_minute_stats"] = """
SELECT match_id, half, minute,
  CAST(55 + sum(k) % 11 AS DECIMAL(6,2)) AS clip_duration_seconds,
  CAST(sum(CASE WHEN k < 70 AND holder % 2 = 0 THEN 1 ELSE 0 END) AS INT) AS frames_team_a,
  CAST(sum(CASE WHEN k < 70 AND holder % 2 = 1 THEN 1 ELSE 0 END) AS INT) AS frames_team_b,
  CAST(sum(CASE WHEN k >= 70 AND k < 85 THEN 1 ELSE 0 END) AS INT) AS frames_loose,
  CAST(sum(CASE WHEN k >= 85 THEN 1 ELSE 0 END) AS INT) AS frames_oof,
  CAST(sum(k) % 7 AS INT) AS passes_completed_team_a, CAST(sum(k) % 5 AS INT) AS passes_completed_team_b,
  CAST(sum(k) % 3 AS INT) AS interceptions_team_a, CAST(sum(k + 1) % 3 AS INT) AS interceptions_team_b,
  CAST(sum(k) % 2 AS INT) AS ball_lost_team_a, CAST(sum(k + 1) % 2 AS INT) AS ball_lost_team_b,
  CAST(0 AS INT) AS revision,
  CAST(CASE WHEN max(mno) % 3 = 0 AND half = 1 AND minute <= 2 THEN 1 ELSE 0 END AS INT) AS superseded
FROM fx_frames GROUP BY match_id, half, minute"""

# raw carrier state of every frame, as the possession rules see it
TEXT["fx_carrier"] = """
SELECT match_id, mno, frame_idx, half, minute,
  CASE WHEN k < 70 THEN 'carrier' WHEN k < 85 THEN 'loose' ELSE 'oof' END AS kind,
  CASE WHEN k < 70 THEN CAST(holder AS BIGINT) END AS track_id,
  CASE WHEN k < 70 THEN CAST(holder % 2 AS INT) END AS team_id
FROM fx_frames"""

# raw model boxes: players, officials, posts, balls and one unknown class
TEXT["fx_detections"] = """
SELECT match_id, frame_idx, CAST(track_id AS BIGINT) AS det_id,
  CAST(CASE WHEN track_id < 10 THEN 0 WHEN track_id = 10 THEN 3 WHEN frame_idx % 2 = 0 THEN 2 ELSE 7 END AS INT) AS class_id,
  confidence, x1 - 300 + 75e-2 AS x1, y1 + 25e-2 AS y1, x2 - 300 + 5e-1 AS x2, y2 + 5e-1 AS y2
FROM fx_players
UNION ALL
SELECT match_id, frame_idx, CAST(100 + ball_no AS BIGINT) AS det_id, CAST(1 AS INT) AS class_id,
  confidence, cx - 8 + 25e-2 AS x1, cy - 8 + 5e-1 AS y1, cx + 9 + 75e-2 AS x2, cy + 8 + 0e0 AS y2
FROM fx_balls"""

TEXT["fx_matches"] = """
SELECT match_id, mno,
  CASE WHEN mno % 4 = 1 THEN '' WHEN mno % 4 = 2 THEN CAST(NULL AS VARCHAR(20)) ELSE concat('Home ', CAST(mno AS VARCHAR(20))) END AS team_a_name,
  CASE WHEN mno % 5 = 1 THEN '' ELSE concat('Away ', CAST(mno AS VARCHAR(20))) END AS team_b_name,
  CASE WHEN mno % 3 = 0 THEN 'orange' WHEN mno % 3 = 1 THEN '#FF0000' ELSE '' END AS team_a_colour,
  CASE WHEN mno % 2 = 0 THEN 'navy' ELSE '#0f8' END AS team_b_colour,
  CASE WHEN mno % 4 = 3 THEN CAST(NULL AS VARCHAR(20)) ELSE 'yellow' END AS team_a_gk_colour,
  CASE WHEN mno % 5 = 4 THEN '' ELSE 'black' END AS team_b_gk_colour,
  CASE WHEN mno % 2 = 0 THEN 'futsal' ELSE 'classic' END AS ruleset,
  CAST(CASE WHEN mno % 3 = 1 THEN 1 WHEN mno % 3 = 2 THEN 0 END AS INT) AS team_a_cluster_id,
  min(ts) AS created_at
FROM fx_frames GROUP BY match_id, mno"""

# one upload or reset request per event, in arrival order
TEXT["fx_requests"] = """
SELECT match_id, mno, event_id, frame_idx AS seq, ts,
  CASE WHEN k = 17 THEN 'reset' ELSE 'clip' END AS request,
  CASE WHEN event_id % 5 = 0 THEN concat('A', CAST(event_id % 7 AS VARCHAR(20))) END AS team_a_name,
  CASE WHEN event_id % 6 = 0 THEN concat('B', CAST(event_id % 7 AS VARCHAR(20))) END AS team_b_name,
  CASE WHEN event_id % 9 = 0 THEN CASE WHEN k < 40 THEN '#FF6600' WHEN k < 80 THEN ' ff6600' ELSE 'Orange' END END AS team_a_colour,
  CASE WHEN event_id % 10 = 0 THEN CASE WHEN k < 60 THEN 'navy' WHEN k < 90 THEN ' NAVY ' ELSE '#000080' END END AS team_b_colour,
  CASE WHEN event_id % 11 = 0 THEN CASE WHEN k < 50 THEN 'yellow' ELSE '##Yellow' END END AS team_a_gk_colour,
  CASE WHEN event_id % 13 = 0 THEN CASE WHEN k < 70 THEN 'lime' ELSE 'teal' END END AS team_b_gk_colour,
  CASE WHEN k % 10 = 0 THEN 'video/avi' WHEN k % 10 = 1 THEN CAST(NULL AS VARCHAR(20)) WHEN k % 10 < 5 THEN 'application/octet-stream' ELSE 'video/mp4' END AS content_type,
  CASE WHEN event_id % 17 = 0 THEN CAST(NULL AS BIGINT) WHEN event_id % 19 = 0 THEN 9000000000 + event_id ELSE 1000 * event_id END AS size_bytes,
  CAST(k - 3 AS DOUBLE) AS clip_duration_seconds,
  CAST(CASE WHEN event_id % 23 = 0 THEN 0 WHEN event_id % 3 = 0 THEN NULL ELSE 1 + event_id % 2 END AS INT) AS half,
  CAST(CASE WHEN event_id % 29 = 0 THEN 0 WHEN event_id % 4 = 0 THEN NULL ELSE 1 + k % 20 END AS INT) AS minute,
  CASE WHEN event_id % 31 = 0 THEN 'beach' WHEN event_id % 2 = 0 THEN 'futsal' ELSE 'classic' END AS ruleset
FROM fx_ev"""

# queue bodies: full, sparse, malformed
TEXT["fx_messages"] = """
SELECT event_id AS message_id, CAST(k % 6 AS INT) AS dequeue_count,
  CASE WHEN k % 20 = 0 THEN concat('{"match_id": "', match_id, '", "half": ')
       WHEN k % 20 < 5 THEN concat('{"match_id": "', match_id, '", "blob_path": "b/', CAST(event_id AS VARCHAR(20)), '.mp4"}')
       WHEN k % 20 < 8 THEN concat('{"match_id": "', match_id, '", "blob_path": "v.mp4", "kind": "post_processing", "team_a_name": "A", "team_b_colour": "#0f8"}')
       ELSE concat('{"match_id": "', match_id, '", "blob_path": "b/', CAST(event_id AS VARCHAR(20)), '.mp4", "kind": "clip", "half": ',
                   CAST(1 + event_id % 2 AS VARCHAR(20)), ', "minute": ', CAST(1 + k AS VARCHAR(20)), ', "clip_duration_seconds": ',
                   CAST(55 + k % 11 AS VARCHAR(20)), '.5, "ordering_retries": ', CAST(k % 4 AS VARCHAR(20)), '}') END AS body
FROM fx_ev"""

# clips in arrival order: repeats, gaps and missing minutes occur
TEXT["fx_clips"] = """
SELECT match_id, mno, event_id, frame_idx AS arrival, ts,
  CAST(CASE WHEN k % 10 < 6 THEN 1 ELSE 2 END AS INT) AS half,
  CAST(CASE WHEN k % 3 = 0 THEN NULL ELSE 1 + k % 30 END AS INT) AS minute,
  CAST(k % 6 AS INT) AS dequeue_count, CAST(1 + floor(frame_idx / 200) AS INT) AS wanted_generation,
  CAST(CASE WHEN k % 7 = 0 THEN NULL ELSE k % 2 END AS INT) AS team_a_cluster_id
FROM fx_ev"""

# clips as they were processed; minute numbers sometimes skip
TEXT["fx_processed"] = """
SELECT match_id, mno, half, minute, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame,
  CAST(CASE WHEN sum(k) % 9 = 0 THEN NULL ELSE sum(k) % 2 END AS INT) AS team_a_cluster_id,
  CAST(1 + floor((CASE WHEN half = 1 THEN 0 ELSE 15 END + minute) / 7) AS INT) AS wanted_generation,
  min(ts) AS started_at, max(ts) AS ended_at
FROM fx_frames WHERE NOT (half = 1 AND minute = 5 AND mno % 3 = 1) AND NOT (half = 2 AND minute = 1 AND mno % 4 = 2)
GROUP BY match_id, mno, half, minute"""

# rows of the outbox, and every answer the receiver gave or would give
TEXT["fx_outbox"] = """
SELECT match_id, half, minute, CAST((frames_team_a * 7 + frames_team_b * 3 + passes_completed_team_a) % 10 AS INT) AS seed,
  CASE WHEN frames_loose % 5 = 0 THEN 'sent' ELSE 'pending' END AS status, CAST(frames_oof % 2 AS INT) AS attempts
FROM fx_minute_stats"""

TEXT["fx_answers"] = """
SELECT f.match_id, f.half, f.minute, CAST(t.try_no AS INT) AS try_no,
  CAST(CASE WHEN (f.seed + t.try_no * 3) % 10 < 4 THEN 200 WHEN (f.seed + t.try_no) % 10 = 5 THEN 401
            WHEN (f.seed * t.try_no) % 10 = 6 THEN NULL ELSE 500 END AS INT) AS http_status
FROM fx_outbox f {each:try_no:1:3}"""

# 14 pitch keypoints per frame; index 13 is beyond the layout
TEXT["fx_keypoints"] = """
SELECT f.match_id, f.frame_idx, CAST(t.idx AS INT) AS idx,
  ((f.event_id * 13 + t.idx * 37 + f.k * t.idx) % 100) / 100e0 AS conf,
  ((f.event_id * 7 + t.idx * 151) % 1280) + 25e-2 AS px,
  ((f.event_id * 3 + t.idx * 89) % 720) + 5e-1 AS py
FROM fx_frames f {each:idx:0:13}"""

# solver output per frame: matrix entries, condition number, inliers
TEXT["fx_solves"] = """
SELECT match_id, frame_idx, k,
  CASE WHEN k % 10 = 0 THEN 2e7 ELSE 1000e0 + k END AS cond, CAST(3 + event_id % 6 AS INT) AS inliers,
  (30e0 + k % 7) / 1000e0 AS h11, (k % 5) / 10000e0 AS h12, -(1e0 + k % 9) AS h13,
  (k % 3) / 10000e0 AS h21, (25e0 + k % 11) / 1000e0 AS h22, -(1e0 + k % 4) AS h23,
  (k % 4) / 1000000e0 AS h31, (k % 6) / 1000000e0 AS h32, 1e0 AS h33
FROM fx_frames"""

# colour texts as callers send them
TEXT["fx_colours"] = """
SELECT event_id, k, CASE WHEN k % 25 < 23 THEN CASE CAST(k % 25 AS INT)
    WHEN 0 THEN 'white' WHEN 1 THEN ' Black ' WHEN 2 THEN 'grey' WHEN 3 THEN 'silver' WHEN 4 THEN 'RED'
    WHEN 5 THEN 'maroon' WHEN 6 THEN 'orange' WHEN 7 THEN 'gold' WHEN 8 THEN 'yellow' WHEN 9 THEN 'lime'
    WHEN 10 THEN '#FF6600' WHEN 11 THEN 'ff6600' WHEN 12 THEN '#0f8' WHEN 13 THEN '##ABC' WHEN 14 THEN ' #12ab9F '
    WHEN 15 THEN 'purple' WHEN 16 THEN 'skyblue' WHEN 17 THEN 'brown' WHEN 18 THEN 'pink' WHEN 19 THEN 'cyan'
    WHEN 20 THEN '' WHEN 21 THEN 'mauve' ELSE '#12345' END END AS colour
FROM fx_ev"""

# 6x6 pixels of one crop per frame
TEXT["fx_pixels"] = """
SELECT f.match_id, f.frame_idx, CAST(f.holder AS BIGINT) AS track_id, CAST(t.p % 6 AS INT) AS px, CAST(floor(t.p / 6) AS INT) AS py,
  CAST(6 AS INT) AS crop_w, CAST(6 AS INT) AS crop_h,
  CAST((f.event_id * 5 + t.p * 11 + f.k) % 180 AS INT) AS hue,
  CAST((f.event_id * 3 + t.p * 17) % 256 AS INT) AS sat, CAST((f.k * 2 + t.p * 7) % 256 AS INT) AS val
FROM fx_frames f {each:p:0:35}"""

# one crop per player box with its measured sharpness and number reading
TEXT["fx_crops"] = """
SELECT match_id, frame_idx, track_id, team_id, CAST(frame_idx * 12 + track_id AS BIGINT) AS arrival,
  CAST(16 + (x1 + frame_idx) % 50 AS INT) AS crop_w, CAST(20 + y2 % 70 AS INT) AS crop_h,
  ((x1 * 7 + y1 * 3) % 2000) / 10e0 AS sharpness,
  CASE WHEN x1 % 3 = 0 THEN concat('#', CAST(track_id + 1 AS VARCHAR(20))) WHEN x1 % 3 = 1 THEN 'ab'
       ELSE concat(' ', CAST(y1 % 10 AS VARCHAR(20)), '-', CAST(track_id AS VARCHAR(20))) END AS ocr_text,
  confidence AS ocr_conf
FROM fx_players"""

# colour of every player box in the cylindrical space
TEXT["fx_player_colours"] = """
SELECT match_id, frame_idx, track_id, team_id,
  CASE WHEN (frame_idx + track_id) % 9 = 0 THEN NULL ELSE ((x1 * 3 + y1) % 511) - 255e0 END AS ca,
  CASE WHEN (frame_idx + track_id) % 9 = 0 THEN NULL ELSE ((x1 + y1 * 5) % 511) - 255e0 END AS cb,
  CASE WHEN (frame_idx + track_id) % 9 = 0 THEN NULL ELSE (y2 % 256) + 0e0 END AS cv
FROM fx_players"""

# lost and newly seen tracks, one per embedding; 100 vectors make one match
TEXT["fx_vectors"] = """
SELECT concat('v', CAST(CAST(floor(vec_id / 100) AS BIGINT) AS VARCHAR(20))) AS match_id, vec_id, label,
  CAST(label % 2 AS INT) AS team_id, CAST(vec_id % 100 AS BIGINT) AS pos, CAST((vec_id % 100) * 41 AS BIGINT) AS frame_idx, embedding
FROM embeddings"""

_EACH = re.compile(r"\{each:(\w+):(\d+):(\d+)\}")
_NAME = re.compile(r"\bfx_\w+")


def needs(text: str) -> list[str]:
    """Fixture tables a text reads, each after those it depends on."""
    found: list[str] = []

    def visit(t: str) -> None:
        for name in _NAME.findall(t):
            if name in TEXT and name not in found:
                visit(TEXT[name])
                if name not in found:
                    found.append(name)

    visit(text)
    return found


def check_sql(body: str) -> str:
    """Text for the checking engine: the fixture tables, then the query.

    ``body`` may start with more tables, written as ``name AS (...), ... SELECT``,
    after the marker ``WITH``.
    """
    body = body.strip()
    tables = [f"{n} AS MATERIALIZED ({_duck(TEXT[n]).strip()})" for n in needs(body)]
    if body.upper().startswith("WITH "):
        body = body[5:].strip()
        return "WITH RECURSIVE " + ",\n".join([*tables, body])
    return ("WITH RECURSIVE " + ",\n".join(tables) + "\n" if tables else "") + body


def _duck(text: str) -> str:
    return _EACH.sub(
        lambda m: f"CROSS JOIN (SELECT unnest(range({m[2]}, {int(m[3]) + 1})) AS {m[1]}) t", text
    )


def _spark(text: str) -> str:
    text = _EACH.sub(
        lambda m: f"LATERAL VIEW explode(sequence(bigint({m[2]}), bigint({m[3]}))) t AS {m[1]}", text
    )
    return re.sub(r"VARCHAR\(20\)", "STRING", text)


# frames of a folder, written once per application: nearly every table starts from them
_FRAMES: dict[tuple[str, str], DataFrame] = {}


class Fixtures:
    """The derived tables of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or f"fx_{name}" not in TEXT:
            raise AttributeError(name)
        return self.table(f"fx_{name}")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            own = getattr(self, f"_{name}", None)
            self._made[name] = own() if own else self.sql(TEXT[name])
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in TEXT:
                self.table(name).createOrReplaceTempView(name)
        for raw in ("events", "embeddings"):
            if re.search(rf"\bFROM {raw}\b", text):
                self.raw(raw).createOrReplaceTempView(raw)
        return self.spark.sql(_spark(text))

    def _fx_balls(self) -> DataFrame:
        # every track has a box in every frame, so the box of the holder follows from the frame without a join
        boxes, _ = TEXT["fx_players"].split("FROM fx_frames f")
        held = f"{boxes.replace('t.track_id', 'f.holder')}, f.event_id, f.k FROM fx_frames f WHERE f.k < 85"
        start, end = TEXT["fx_balls"].index("FROM (") + len("FROM ("), TEXT["fx_balls"].index(") f {each")
        return self.sql(TEXT["fx_balls"][:start] + held + TEXT["fx_balls"][end:])

    def _fx_ev(self) -> DataFrame:
        mno = F.floor(F.col("user_id") / 12)
        events = self.raw("events").select(
            "event_id",
            "user_id",
            mno.alias("mno"),
            F.concat(F.lit("m"), mno.cast("string")).alias("match_id"),
            F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
            "event_type",
            "value",
            "ts",
        )
        return scans.number_rows(events, ["mno"], scans.time_bucket("ts"), ["ts", "event_id"], "frame_idx")

    def _fx_frames(self) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.dir)
        if key not in _FRAMES:
            _FRAMES[key] = durable(self._frames())
        return _FRAMES[key]

    def _frames(self) -> DataFrame:
        ev = self.table("fx_ev")
        half2 = F.col("frame_idx") >= 450
        return ev.select(
            "match_id",
            "mno",
            "event_id",
            "frame_idx",
            "k",
            "ts",
            # six frames at most share a window
            F.expr(
                "first_value(user_id) OVER (PARTITION BY match_id, floor(frame_idx / 6) ORDER BY frame_idx) % 12"
            ).alias("holder"),
            F.when(half2, 2).otherwise(1).cast("int").alias("half"),
            (1 + F.floor((F.col("frame_idx") - F.when(half2, 450).otherwise(0)) / 30)).cast("int").alias("minute"),
        )
