"""Cases that dropped rows, stopped a job, or kept a session for ever."""

import json

import pandas as pd
from touchline.operators import delivery, teams
from touchline.streaming import live

CLIP = "match_id string, half int, minute int"


def test_ledger_keeps_rows_without_answers(spark):
    rows = spark.createDataFrame([("m", 1, i, "pending", 0) for i in range(1, 6)], f"{CLIP}, status string, attempts int")
    answers = [("m", 1, 2, 1, 500), ("m", 1, 3, 1, 200), ("m", 1, 4, 1, 401), *[("m", 1, 5, t, 500) for t in (1, 2, 3)]]
    got = delivery.ledger(rows, spark.createDataFrame(answers, f"{CLIP}, try_no int, http_status int"))
    want = {1: ("pending", 0), 2: ("pending", 1), 3: ("sent", 1), 4: ("failed", 1), 5: ("failed", 3)}
    assert {r["minute"]: (r["status"], r["attempts"]) for r in got.collect()} == want


def test_silhouette_has_a_status_per_match(spark):
    data = [("few", 0, [1.0, 2.0])] * 3 + [("equal", i % 2, [1.0, 1.0]) for i in range(12)] + [("apart", i % 2, [9.0 * (i % 2), 1.0]) for i in range(12)]
    got = teams.silhouette(spark.createDataFrame(data, "match_id string, cluster int, embedding array<double>")).collect()
    assert {r["match_id"]: (r["n"], r["score"], r["status"]) for r in got} == {"few": (3, None, "too_few"), "equal": (12, 0.0, "ok"), "apart": (12, 1.0, "ok")}


class Store:
    """State and timers of one key, in memory."""

    def __init__(self):
        self.value, self.map, self.timers = None, {}, set()

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        store = Store()
        return store

    def registerTimer(self, at):
        self.timers.add(at)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        return key in self.map

    def updateValue(self, key, value):
        self.map[key] = value

    def getValue(self, key):
        return self.map[key]

    def removeKey(self, key):
        del self.map[key]

    def keys(self):
        return iter(list(self.map))

    def iterator(self):
        return iter(list(self.map.items()))


class At:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_idle_session_is_forgotten_once(monkeypatch):
    counts = dict.fromkeys(live.COUNTERS, 0)
    ran = []

    def run_clip(body, clip, rules):
        ran.append((clip["half"], clip["minute"]))
        body["ball"] = "busy"
        return {"fix": None, "reset": False, "body": counts, "counts": counts, "events": []}

    monkeypatch.setattr(live, "run_clip", run_clip)
    sessions, store = live.MatchSessions({}, hold_s=30, idle_s=1800), Store()
    sessions.init(store)

    def send(now, half, minute):
        part = pd.DataFrame([("m", half, minute, 1, None, "[]")], columns=["match_id", "half", "minute", "wanted_generation", "team_a_cluster_id", "frames"])
        list(sessions.handleInputRows(("m",), iter([part]), At(now)))

    for i in range(45):
        send(i * 60_000, 1, i + 1)
    send(45 * 60_000, 1, 48)  # out of turn: waits, then runs
    calls = 0
    while store.timers and calls < 500:
        now = min(store.timers)
        store.timers.discard(now)
        list(sessions.handleExpiredTimer(("m",), At(now), None))
        calls += 1
    assert ran == [(1, i + 1) for i in range(45)] + [(1, 48)]
    assert calls <= 47 and json.loads(store.value[0])["ball"] != "busy"
