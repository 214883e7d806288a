"""The stream: order, replays, gaps, delivery."""

import json

import pandas as pd
from pyspark.sql import functions as F

from touchline.functions.counters import COUNTERS
from touchline.operators.rulesets import get_ruleset
from touchline.session import scratch_path
from touchline.sources import logs
from touchline.streaming import live
from touchline.streaming.session_steps import new_session, run_clip

RULES = get_ruleset("futsal")


def clip(half, minute, n=5, **extra):
    players = [{"track_id": 1, "team_id": 0, "x1": 0, "y1": 0, "x2": 40, "y2": 100}]
    frames = [{"cx": 20, "cy": 95, "confidence": 0.9, "players": players}] * n
    return {"half": half, "minute": minute, "frames": frames, **extra}


def test_session_counts_and_payload():
    body = new_session()
    first = run_clip(body, clip(1, 1), RULES)
    assert (first["counts"]["frames_team_a"], first["counts"]["frames_oof"]) == (3, 2)
    second = run_clip(body, clip(1, 2, team_a_cluster_id=1), RULES)
    assert second["counts"]["frames_team_b"] == 5 and second["body"]["frames_team_a"] == 3


def test_newer_generation_restarts_totals_only():
    body = new_session()
    run_clip(body, clip(1, 1), RULES)
    held = body["held"]
    out = run_clip(body, clip(1, 2, wanted_generation=2), RULES)
    assert out["reset"] and out["body"]["frames_team_a"] == 5 and body["held"] == held


def run(spark, clips, **timing):
    source, target = scratch_path(spark, "clips"), scratch_path(spark, "live")
    rows = [("m", c["half"], c["minute"], c.get("wanted_generation", 1), c.get("team_a_cluster_id"), json.dumps(c["frames"])) for c in clips]
    for r in rows:
        spark.createDataFrame([r], live.CLIP).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(live.CLIP).option("maxFilesPerTrigger", 1).parquet(source)
    live.run_live(stream, RULES, target, **timing).awaitTermination()
    return target


def test_out_of_order_and_replayed_clips(spark):
    target = run(spark, [clip(1, 2), clip(1, 1), clip(1, 1), clip(1, 3)])
    rows = live.written(spark, target, "clips").orderBy("half", "minute").collect()
    assert [(r.half, r.minute, r.gap) for r in rows] == [(1, 1, False), (1, 2, False), (1, 3, False)]
    assert [json.loads(r.payload)["frames_a"] for r in rows] == [3, 8, 13]


def test_clip_is_held_then_run_with_a_gap(spark):
    held = run(spark, [clip(1, 1), clip(1, 4)])
    assert live.written(spark, held, "clips").count() == 1
    forced = run(spark, [clip(1, 1), clip(1, 4)], hold_s=0)
    rows = live.written(spark, forced, "clips").orderBy("minute").collect()
    assert [(r.minute, r.gap) for r in rows] == [(1, False), (4, True)]


def test_unfinished_batch_is_not_read(spark):
    target = run(spark, [clip(1, 1)])
    extra = live.written(spark, target, "clips").drop("batch_id")
    extra.write.mode("overwrite").parquet(f"{target}/clips/batch_id=99")
    assert live.written(spark, target, "clips").count() == 1


def test_delivery(spark):
    rows = [("m", 1, i, json.dumps({"i": i}), "pending", 0) for i in (3, 1, 2)] + [("m", 1, 4, "{}", "sent", 1)]
    outbox = spark.createDataFrame(rows, "match_id string, half int, minute int, payload string, status string, attempts int")
    answers = {1: 500, 2: 200, 3: 401}
    out = live.send_pending(outbox, lambda _m, body: answers[json.loads(body)["i"]], lambda _s: None).orderBy("minute").collect()
    assert [(r.minute, r.status, r.attempts) for r in out] == [(1, "failed", 3), (2, "sent", 1), (3, "failed", 1)]


def test_replays_dropped_within_watermark(spark):
    source, target = scratch_path(spark, "uploads"), scratch_path(spark, "uploads-out")
    rows = spark.createDataFrame([("m", 1, 1, "2024-01-01 00:00:00"), ("m", 1, 1, "2024-01-01 00:05:00"), ("m", 1, 2, "2024-01-01 00:06:00")], "match_id string, half int, minute int, ts string")
    rows.withColumn("ts", F.to_timestamp_ntz("ts")).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = live.drop_replays(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", target + "-state")
    query.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(target).count() == 2


def test_keypoint_log_array_file(spark):
    path = scratch_path(spark, "log")
    frame = {"match_id": "m", "frame": 0, "ts": 0.0, "keypoints": [{"idx": 1, "px": 2.0, "py": 3.0, "conf": 0.4}], "n_used": 1, "H_solved": False, "skip_reason": ""}
    body = "[" + json.dumps(frame, indent=1) + ", " + json.dumps(frame | {"frame": 1}) + "]"
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    got = logs.keypoints(logs.read_keypoint_log(spark, path, arrays=True)).orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.idx, r.conf) for r in got] == [(0, 1, 0.4), (1, 1, 0.4)]


def test_counter_names():
    assert len(COUNTERS) == 10


def test_late_clip_sums_minutes_up_to_its_own():
    body = new_session()
    for minute in (1, 3):
        run_clip(body, clip(1, minute), RULES)
    out = run_clip(body, clip(1, 2), RULES)["body"]
    assert sum(v for c, v in out.items() if c.startswith("frames_")) == 10


def test_reset_keeps_minutes_beyond_the_last_clip():
    body = new_session()
    for minute in (1, 4, 2):
        run_clip(body, clip(1, minute), RULES)
    out = run_clip(body, clip(1, 5, wanted_generation=2), RULES)["body"]
    assert sum(v for c, v in out.items() if c.startswith("frames_")) == 10
    assert [m["minute"] for m in body["minutes"]] == [4, 5]


class Kept:
    """A value and a map of the state, counting how often whole maps are read and texts put in."""

    def __init__(self):
        self.value, self.map, self.read, self.put = None, {}, 0, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        return key in self.map

    def getValue(self, key):
        return self.map[key]

    def updateValue(self, key, value):
        self.put += 1
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]

    def keys(self):
        return iter(self.map)

    def iterator(self):
        self.read += 1
        return iter(list(self.map.items()))


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def registerTimer(self, at):
        pass


def arrive(session, now, *places):
    rows = [("m", h, m, 1, None, json.dumps(clip(h, m)["frames"])) for h, m in places]
    part = pd.DataFrame(rows, columns=[f.split()[0] for f in live.CLIP.split(", ")])
    return [(r.half, r.minute, r.gap) for out in session.handleInputRows(("m",), iter([part]), Clock(now)) for r in out.itertuples()]


def sessions():
    made = live.MatchSessions(RULES)
    made.handle, made.session, made.waiting, made.done = Clock(0), Kept(), Kept(), Kept()
    return made


def test_clips_that_wait_are_read_once():
    s = sessions()
    assert arrive(s, 0, (1, 1), (1, 2), (1, 4), (1, 5)) == [(1, 1, False), (1, 2, False)]
    assert arrive(s, 1, (1, 6), (1, 4)) == []
    assert s.waiting.put == 3 and s.waiting.read == 1
    assert arrive(s, 2, (1, 3), (1, 2)) == [(1, m, False) for m in (3, 4, 5, 6)]
    assert s.waiting.put == 3 and s.waiting.read == 1 and not s.waiting.map
    assert arrive(s, 3, (1, 9)) == [] and [len(out) for out in s.handleExpiredTimer(("m",), Clock(40000), None)] == [1]


def test_clips_that_wait_outlive_their_session():
    for forget in (lambda s: setattr(s.session, "value", None), lambda s: s.session.update((json.dumps({k: v for k, v in json.loads(s.session.get()[0]).items() if k != "waiting"}),))):
        s = sessions()
        assert arrive(s, 0, (1, 2)) == []
        forget(s)
        assert arrive(s, 1, (1, 2), (1, 1)) == [(1, 1, False), (1, 2, False)]
