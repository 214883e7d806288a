"""Live matches: a stream of clips becomes minute rows, corrections, events and deliveries.

One row per clip arrives, in any order and possibly more than once. The state of a
match is one session, which lists the places that wait, plus the clips that wait for their turn.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from touchline.functions.counters import COUNTERS, EVENT_KINDS, wire_key
from touchline.operators import ingest
from touchline.operators import minutes as mn
from touchline.operators.joins import dealt
from touchline.session import ROCKSDB, shared_dir
from touchline.streaming.session_steps import new_session, run_clip

HOLD_S = ingest.ORDERING_RETRIES * ingest.ORDERING_RETRY_S
IDLE_S = 1800
KEEP_S = 7 * 24 * 3600

CLIP = "match_id string, half int, minute int, wanted_generation int, team_a_cluster_id int, frames string"
EVENTS = (
    "array<struct<frame_idx:bigint,kind:string,from_team:int,to_team:int,from_track:bigint,to_track:bigint,travel_frames:int>>"
)
RESULT = (
    "match_id string, half int, minute int, n_frames int, gap boolean, reset boolean, upto_half int, upto_minute int, "
    + ", ".join(f"{c} int" for c in COUNTERS)
    + f", events {EVENTS}, corr_half int, corr_minute int, corr_kind string, corr_team int, corr_frames int, payload string"
)
RESULT_NAMES = [f.split()[0] for f in RESULT.replace(EVENTS, "list").split(", ")]


class MatchSessions(StatefulProcessor):
    """Orders the clips of a match, runs them, and forgets an idle session.

    An idle session keeps its minutes and place. These and the list of clips that ran go ``keep_s`` after
    they last changed; a clip that comes again later runs again, and ``minute_table`` reads its first result.
    """

    def __init__(self, rules: dict, hold_s: float = HOLD_S, idle_s: float = IDLE_S, keep_s: float = KEEP_S):
        self.rules, self.hold_ms, self.idle_ms, self.keep_ms = rules, int(hold_s * 1000), int(idle_s * 1000), int(keep_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "body string", self.keep_ms)
        self.waiting = handle.getMapState("waiting", "half int, minute int", "clip string, since bigint")
        self.done = handle.getMapState("done", "half int, minute int", "at bigint", self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        body, fresh = self._load() or self._begin(now), {}
        held = {(h, m) for h, m, _ in body["waiting"]}
        for part in rows:
            for r in part.itertuples(index=False):
                at = (int(r.half), int(r.minute))
                if at in held or at in fresh or self.done.containsKey(at):
                    continue
                clip = {
                    "half": at[0],
                    "minute": at[1],
                    "wanted_generation": 1 if pd.isna(r.wanted_generation) else int(r.wanted_generation),
                    "team_a_cluster_id": None if pd.isna(r.team_a_cluster_id) else int(r.team_a_cluster_id),
                }
                # the frames stay text until the clip runs
                fresh[at] = f'{json.dumps(clip)[:-1]}, "frames": {r.frames}}}'
                body["waiting"].append([*at, now])
        self.handle.registerTimer(now + self.idle_ms)
        yield self._advance(key, now, body, fresh, touched=True)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Only input moves the time a session is forgotten; a timer that is early for that leaves no new one."""
        now = timerValues.getCurrentProcessingTimeInMs()
        body = self._load()
        waiting = self._held() if body is None else body["waiting"]
        if waiting:
            yield self._advance(key, now, body or self._begin(now), {})
            return
        if body and now - body["touched"] >= self.idle_ms:
            kept = {k: body[k] for k in ("progress", "due", "generation", "minutes", "touched", "waiting")}
            self.session.update((json.dumps(new_session() | kept),))
        yield pd.DataFrame(columns=RESULT_NAMES)

    def _load(self) -> dict | None:
        if not self.session.exists():
            return None
        body = json.loads(self.session.get()[0])
        return body if "waiting" in body else body | {"waiting": self._held()}

    def _begin(self, now: int) -> dict:
        return new_session() | {"due": [[1, 1]], "touched": now, "waiting": self._held()}

    def _held(self) -> list:
        """Places of the clips in the state, for a session that does not list them: reading them reads their texts too."""
        return [[*k, v[1]] for k, v in self.waiting.iterator()]

    def _advance(self, key: Any, now: int, body: dict, fresh: dict, touched: bool = False) -> pd.DataFrame:
        """Run every clip whose turn has come, and those that have waited long enough.

        The session lists the places that are due next, which every clip that runs sets anew, and those that wait. Clips of
        ``fresh`` go to the state only if they have to wait.
        """
        queue = sorted(((h, m), since) for h, m, since in body["waiting"])
        out = []
        while queue:
            ready = [q for q in queue if list(q[0]) in body["due"]]
            late = [q for q in queue if now - q[1] >= self.hold_ms]
            if not ready and not late:
                break
            turn = (ready or late)[0]
            queue.remove(turn)
            if turn[0] in fresh:
                text = fresh.pop(turn[0])
            else:
                text = self.waiting.getValue(turn[0])[0]
                self.waiting.removeKey(turn[0])
            out.append(self._run(key, body, json.loads(text), gap=not ready))
            self.done.updateValue(turn[0], (now,))
        for at, text in fresh.items():
            self.waiting.updateValue(at, (text, now))
        if touched:
            body["touched"] = now
        body["waiting"] = [[*at, since] for at, since in queue]
        self.session.update((json.dumps(body),))
        if queue:
            self.handle.registerTimer(min(since for _, since in queue) + self.hold_ms)
        return pd.DataFrame(out, columns=RESULT_NAMES)

    def _run(self, key: Any, body: dict, clip: dict, gap: bool) -> list:
        before = body["progress"] or [None, None]
        result = run_clip(body, clip, self.rules)
        body["due"] = [[clip["half"], clip["minute"] + 1], [clip["half"] + 1, 1]]
        fix = result["fix"] or dict.fromkeys(("half", "minute", "kind", "team_id", "frames"))
        payload = {wire_key(c): result["body"][c] for c in COUNTERS}
        upto = before if result["reset"] else [None, None]
        return [
            key[0], clip["half"], clip["minute"], len(clip["frames"]), gap, result["reset"], *upto,
            *[result["counts"][c] for c in COUNTERS], [e | {"kind": EVENT_KINDS[e["kind"]]} for e in result["events"]],
            *fix.values(), json.dumps(payload, separators=(",", ":")),
        ]

    def close(self) -> None:
        pass


def clip_rows(frames: DataFrame, players: DataFrame, balls: DataFrame, extra: list[str]) -> DataFrame:
    """Clip rows for the stream: the frames of a clip as one JSON text.

    A clip lasts about a minute, which bounds the row. ``extra`` names clip columns on
    ``frames`` to carry along.
    """
    at = ["match_id", "frame_idx"]
    box = F.struct("track_id", "team_id", "x1", "y1", "x2", "y2")
    team = players.groupBy(*at).agg(F.collect_list(box).alias("players"))
    full = frames.join(dealt(balls.select(*at, "cx", "cy", "confidence")), at, "left").join(dealt(team), at, "left")
    frame = F.struct("frame_idx", "cx", "cy", "confidence", "players")
    clips = full.groupBy("match_id", "half", "minute").agg(F.to_json(F.sort_array(F.collect_list(frame))).alias("frames"),
                                                         *[F.first(c).alias(c) for c in extra])
    defaults = {"wanted_generation": F.lit(1), "team_a_cluster_id": F.lit(None).cast("int")}
    return clips.withColumns({c: e for c, e in defaults.items() if c not in extra}).select(*[f.split()[0] for f in CLIP.split(", ")])


def live_results(clips: DataFrame, rules: dict, hold_s: float = HOLD_S, idle_s: float = IDLE_S, keep_s: float = KEEP_S) -> DataFrame:
    """Result row of every clip, as its turn comes."""
    clips.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return clips.groupBy("match_id").transformWithStateInPandas(
        statefulProcessor=MatchSessions(rules, hold_s, idle_s, keep_s), outputStructType=RESULT, outputMode="Append", timeMode="ProcessingTime"
    )


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Write everything a batch produced under its own id, and mark it complete last.

    A batch that runs again overwrites its own folders, so nothing is counted twice; a
    batch without its mark is not read.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        part = f"batch_id={batch_id}"
        rows = df.persist()
        try:
            rows.drop("events").write.mode("overwrite").parquet(f"{path}/clips/{part}")
            events = rows.select(*mn.CLIP, F.explode("events").alias("e")).select(*mn.CLIP, "e.*")
            events.write.mode("overwrite").parquet(f"{path}/events/{part}")
            rows.select(*mn.CLIP, "payload", F.lit("pending").alias("status"), F.lit(0).alias("attempts")).write.mode("overwrite").parquet(
                f"{path}/outbox/{part}"
            )
            df.sparkSession.range(1).write.mode("overwrite").parquet(f"{path}/complete/{part}")
        finally:
            rows.unpersist()

    return write


def written(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of complete batches."""
    complete = spark.read.parquet(f"{path}/complete").select("batch_id").distinct()
    return spark.read.parquet(f"{path}/{table}").join(complete, "batch_id", "left_semi")


def minute_table(spark: SparkSession, path: str) -> DataFrame:
    """Minute rows as they stand: corrected, and flagged where a reset supersedes them.

    Of a clip that ran again after its session was gone, the first result counts.
    """
    first = F.row_number().over(Window.partitionBy(*mn.CLIP).orderBy("batch_id"))
    clips = written(spark, path, "clips").withColumn("_nth", first).filter("_nth = 1")
    rows = clips.select(*mn.CLIP, *COUNTERS, F.lit(0).alias("revision"), F.lit(0).alias("superseded"))
    fixes = clips.filter("corr_kind IS NOT NULL").select(
        "match_id", F.col("corr_half").alias("half"), F.col("corr_minute").alias("minute"), F.col("corr_kind").alias("kind"),
        F.col("corr_team").alias("team_id"), F.col("corr_frames").alias("frames"),
    )
    resets = clips.filter("upto_half IS NOT NULL").select("match_id", "upto_half", "upto_minute")
    return mn.supersede(mn.apply_corrections(rows, fixes), resets)


def run_live(clips: DataFrame, rules: dict, path: str, checkpoint: str | None = None, once: bool = True, **timing):
    """Start the live query into ``path``.

    ``once`` works off the clips that are there and stops; clips still waiting for an
    earlier one stay in the state for the next start. Otherwise the query keeps running
    and its timers fire between clips.
    """
    spark = clips.sparkSession
    shared_dir(spark)
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle)
    # processing-time timers ask for empty batches without end, which a one-off run must not wait for
    spark.conf.set(idle, str(not once).lower())
    try:
        writer = live_results(clips, rules, **timing).writeStream.outputMode("append").foreachBatch(batch_writer(path))
        writer = writer.option("checkpointLocation", checkpoint or f"{path}/_state")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
    finally:
        spark.conf.set(idle, before)


def drop_replays(clips: DataFrame, late: str = "1 hour") -> DataFrame:
    """First of each clip among those whose ``ts`` lies within ``late`` of each other.

    Repeats further apart pass; ``late`` bounds the state. A caller who needs them gone compares with the
    minutes already written.
    """
    timed = clips.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.dropDuplicatesWithinWatermark(["match_id", "half", "minute"])


def send_pending(outbox: DataFrame, sender: Callable[[str, str], int | None], wait: Callable[[float], None], tries: int = 3) -> DataFrame:
    """Deliver pending rows in order per match through ``sender(match_id, payload)``.

    ``sender`` returns an HTTP status, or None when nobody answered. A 401 stops the
    tries of a row; a row that fails does not hold up the next. Rows stream through the
    task in order, one match per partition key, and none is kept in memory.
    """
    from touchline.operators.delivery import UNAUTHORISED, retry_wait_s

    def deliver(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            results = []
            for r in part.itertuples(index=False):
                attempts, sent = int(r.attempts), False
                for i in range(tries):
                    attempts += 1
                    status = sender(r.match_id, r.payload)
                    sent = status is not None and 200 <= status < 300
                    if sent or status == UNAUTHORISED:
                        break
                    if i < tries - 1:
                        wait(retry_wait_s(i))
                results.append(("sent" if sent else "failed", attempts))
            yield part.assign(status=[s for s, _ in results], attempts=[a for _, a in results])

    due = outbox.filter(F.col("status") == "pending").select(*mn.CLIP, "payload", "status", "attempts")
    ordered = due.repartition("match_id").sortWithinPartitions(*mn.CLIP)
    return ordered.mapInPandas(deliver, due.schema)
