"""One clip of one match: the per-frame steps of the batch jobs, run along the clip."""

from __future__ import annotations

import math

from touchline.functions.counters import COUNTERS
from touchline.operators import ball as bl
from touchline.operators import passes as ps

EVENT_COLUMN = {ps.COMPLETED: "passes_completed", ps.INTERCEPTION: "interceptions", ps.BALL_LOST: "ball_lost"}


def new_session() -> dict:
    return {
        "at": 0,
        "ball": list(bl.BALL_START),
        "recent": [],
        "held": ["oof", None, None],
        "pass": list(ps.PASS_START),
        "carry": 0,
        "last": None,
        "generation": 1,
        "progress": None,
        "minutes": [],
    }


def nearest_in_zone(x: int, y: int, players: list[dict], rules: dict) -> list:
    """Raw carrier state for a visible ball."""
    inside = []
    for p in players:
        if p.get("team_id") not in (0, 1) or p.get("track_id") is None:
            continue
        reach = rules["foot_zone_ratio"] * max(1, p["y2"] - p["y1"])
        reach = max(rules["foot_zone_min_px"], min(rules["foot_zone_max_px"], reach))
        dist = math.hypot((p["x1"] + p["x2"]) // 2 - x, p["y2"] - y)
        if dist <= reach:
            inside.append((dist, p["track_id"], p["team_id"]))
    if not inside or len({team for _, _, team in inside}) > 1:
        return ["loose", None, None]
    _, track, team = min(inside)
    return ["carrier", track, team]


def move_frames(counts: dict, kind: str, team: int, n: int) -> int:
    """Apply one clamped adjustment to ``counts``; the number of frames moved."""
    own, other = ("frames_team_a", "frames_team_b") if team == 0 else ("frames_team_b", "frames_team_a")
    source, target = (other, own) if kind == "flip_to" else (own, "frames_oof")
    moved = max(0, min(n, counts[source]))
    counts[source] -= moved
    counts[target] += moved
    return moved


def turned(counts: dict, cluster: int | None) -> dict:
    """Counters with sides swapped when team a is cluster 1."""
    if cluster in (None, 0):
        return dict(counts)
    swap = {c: c[:-1] + ("b" if c[-1] == "a" else "a") if "_team_" in c else c for c in counts}
    return {c: counts[swap[c]] for c in counts}


def totals(minutes: list[dict], half: int, minute: int) -> dict:
    """Counters of all ``minutes`` up to this one; a clip that is late leaves out those after it."""
    before = [m["counts"] for m in minutes if (m["half"], m["minute"]) <= (half, minute)]
    return {c: sum(m[c] for m in before) for c in COUNTERS}


def run_clip(session: dict, clip: dict, rules: dict) -> dict:
    """Process the frames of ``clip`` and update ``session``; returns the clip's result.

    ``clip``: half, minute, team_a_cluster_id, wanted_generation, frames (cx, cy,
    confidence, players).
    """
    last = session["last"]
    reset = clip.get("wanted_generation", 1) > session["generation"]
    if reset:
        # colours start anew, and minutes up to the last clip no longer count; ball, carrier and pass state stay
        session["generation"] = clip["wanted_generation"]
        upto = tuple(session["progress"] or (0, 0))
        session["minutes"] = [m for m in session["minutes"] if (m["half"], m["minute"]) > upto]
    n = rules["carrier_hysteresis_n"]
    settings = [rules[k] for k in ps.PASS_INPUTS[3:]]
    counts, events, fix = dict.fromkeys(COUNTERS, 0), [], None
    for frame in clip["frames"]:
        f = session["at"]
        session["at"] += 1
        seen = (frame.get("cx"), frame.get("cy"), frame.get("confidence"), rules["kalman_coast_frames"], rules["kalman_gate_sigma"])
        ball, (state, bx, by, _) = bl.ball_step(tuple(session["ball"]), f, seen)
        session["ball"] = list(ball)
        raw = ["oof", None, None] if state == bl.LOST else nearest_in_zone(bx, by, frame.get("players") or [], rules)
        recent = session["recent"] = (session["recent"] + [raw])[-n:]
        if len(recent) == n and all(r[:2] == raw[:2] for r in recent):
            session["held"] = raw
        moved, result = ps.pass_step(tuple(session["pass"]), f, (*session["held"], *settings))
        session["pass"] = list(moved)
        label, _, event, origin, origin_team, target, target_team, _, spent, kind, team, frames = result[:12]
        counts[f"frames_{label}"] += 1
        if event:
            events.append({"frame_idx": f, "kind": event, "from_team": origin_team, "to_team": target_team,
                           "from_track": origin, "to_track": target, "travel_frames": spent})
            if origin_team in (0, 1):
                counts[f"{EVENT_COLUMN[event]}_{ps.TEAM_LABEL[origin_team]}"] += 1
        if kind:
            prior = min(frames, session["carry"])
            session["carry"] -= prior
            move_frames(counts, kind, team, frames - prior)
            if prior and last and fix is None:
                fix = {"half": last["half"], "minute": last["minute"], "kind": kind, "team_id": team, "frames": prior}
    cluster = clip.get("team_a_cluster_id")
    if fix and last["cluster"] not in (None, 0) and fix["team_id"] in (0, 1):
        fix["team_id"] = 1 - fix["team_id"]
    if fix:
        for m in session["minutes"]:
            if (m["half"], m["minute"]) == (last["half"], last["minute"]):
                move_frames(m["counts"], fix["kind"], fix["team_id"], fix["frames"])
    row = turned(counts, cluster)
    for e in events:
        for side in ("from_team", "to_team"):
            if cluster not in (None, 0) and e[side] in (0, 1):
                e[side] = 1 - e[side]
    session["minutes"].append({"half": clip["half"], "minute": clip["minute"], "counts": row})
    session["progress"] = [clip["half"], clip["minute"]]
    phase, travel = session["pass"][0], session["pass"][-1]
    session["carry"] = travel if phase in ps.MOVING else 0
    session["last"] = {"half": clip["half"], "minute": clip["minute"], "cluster": cluster}
    return {"counts": dict(row), "events": events, "fix": fix, "reset": reset, "body": totals(session["minutes"], clip["half"], clip["minute"])}
