"""Re-identification along time: claims of lost ids, merged summaries, and the full decision log."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.folds import fold
from touchline.operators.joins import dealt
from touchline.operators.scans import FRAME_BUCKET, following, frame_bucket, number_rows, scan
from touchline.operators.tracks import EXPIRY_EVERY, GALLERY_SHOTS, SIM_HIGH, SIM_LOW, TRACK

DECISION = (
    "raw_id bigint, root bigint, candidate bigint, similarity double, verdict boolean, event string, vetoed boolean, "
    "matched boolean, place bigint, digits string, stored_digits string"
)


def _similarity(a: list[float], b: list[float]) -> float:
    return math.sumprod(a, b) / (math.sqrt(math.sumprod(a, a)) * math.sqrt(math.sumprod(b, b)) + 1e-8)


def _claim_step(long_gap: int, ttl: int, high: float, low: float):
    def step(state: tuple, at: int, row: tuple) -> tuple[tuple, tuple]:
        """One frame with new raw tracks. The state is the pool of ids that may still be claimed, with their gallery and number."""
        pool = {k: v for k, v in json.loads(state[0]).items() if at - v["last"] <= ttl}
        lost = sorted((k for k, v in pool.items() if at - v["last"] > long_gap and v["shots"]), key=int)
        asks = []
        for new in json.loads(row[0]):
            best, found = -1.0, None
            if new.get("embedding"):
                for k in lost:
                    alike = max(_similarity(new["embedding"], s["embedding"]) for s in pool[k]["shots"])
                    if alike > best:
                        best, found = alike, k
            asks.append((best, found, new))
        claimed: set[str] = set()
        out = []
        for place, (alike, candidate, new) in enumerate(sorted(asks, key=lambda a: (-a[0], a[2]["raw_id"]))):
            free = candidate is not None and candidate not in claimed
            verdict, event, vetoed = new.get("verdict"), None, False
            stored = pool[candidate]["number"] if free else None
            if free:
                checked = "reid_vlm_skipped_no_ref" if verdict is None else "reid_vlm_checked"
                event = "reid_high_conf" if alike >= high else checked if alike >= low else "reid_below_threshold"
            passes = free and (alike >= high or (alike >= low and bool(verdict)))
            if passes and new.get("digits") is not None and stored and stored[0] != new["digits"]:
                vetoed, passes = True, False
            key = candidate if passes else str(new["raw_id"])
            if passes:
                claimed.add(key)
            held = pool.get(key, {"shots": [], "number": None})
            shots = sorted(held["shots"] + (new.get("shots") or []), key=lambda s: (-s["sharpness"], s["arrival"]))[:GALLERY_SHOTS]
            number = [new["number"]["digits"], new["number"]["conf"]] if new.get("number") else None
            if held["number"] and (number is None or held["number"][1] >= number[1]):
                number = held["number"]
            pool[key] = {"last": new["last"], "shots": shots, "number": number}
            out.append(
                {
                    "raw_id": new["raw_id"], "root": int(key), "candidate": None if candidate is None else int(candidate), "similarity": alike if candidate else None, "verdict": verdict,
                    "event": event, "vetoed": vetoed, "matched": passes, "place": place, "digits": new.get("digits"), "stored_digits": stored[0] if stored else None,
                }
            )
        return (json.dumps(pool, sort_keys=True),), (json.dumps(out),)

    return step


def claims(tracklets: DataFrame, long_gap: int, ttl: int, high: float = SIM_HIGH, low: float = SIM_LOW, size: int = FRAME_BUCKET, warmup: int = 4096) -> DataFrame:
    """Which lost id every raw track takes over, if any, each id by one claimant at a time.

    ``tracklets``: match_id, raw_id, first, last, embedding and digits (of the first crop), verdict (of the outside check),
    shots (its sharpest crops: array of sharpness, arrival, embedding) and number (digits, conf; null without one). An id may
    be claimed while it has been gone for more than ``long_gap`` and at most ``ttl`` frames. A claim
    moves the id's last frame to the end of the claimant and joins gallery and number, so it leaves the pool
    and comes back with that end; raw tracks that claim nothing open ids that can be lost later.

    Returns match_id, frame_idx, raw_id, stable_id (from 0, in order of frame and falling similarity), candidate_id,
    similarity, event, vetoed, matched, new_id (null for claims) and what the log needs. The pool holds the ids of ``ttl`` frames.
    """
    fields = ["raw_id", "last", F.col("embedding").cast("array<double>").alias("embedding"), "digits", "verdict", "number",
              F.col("shots").cast("array<struct<sharpness:double,arrival:bigint,embedding:array<double>>>").alias("shots")]
    asks = tracklets.select("match_id", F.col("first").cast("long").alias("frame_idx"), F.struct(*fields).alias("a"))
    # a frame holds a handful of new tracks
    frames = asks.groupBy("match_id", "frame_idx").agg(F.to_json(F.collect_list("a")).alias("asks"))
    found = fold(frames, ["match_id"], "frame_idx", ["asks"], _claim_step(long_gap, ttl, high, low), ("{}",), "decisions string", size=size, warmup=warmup)
    rows = found.select("match_id", "frame_idx", F.explode(F.from_json("decisions", f"array<struct<{_fields(DECISION)}>>")).alias("d")).select("match_id", "frame_idx", "d.*")
    fresh = number_rows(rows.filter("NOT matched").select("match_id", "frame_idx", "place", "root"), ["match_id"], frame_bucket(size=size), ["frame_idx", "place"], "stable_id")
    names = fresh.select("match_id", "root", "stable_id")
    named = rows.join(names, ["match_id", "root"])
    named = named.join(names.select("match_id", F.col("root").alias("candidate"), F.col("stable_id").alias("candidate_id")), ["match_id", "candidate"], "left")
    return named.select("match_id", "frame_idx", "raw_id", "stable_id", "candidate_id", "similarity", "event", "vetoed", "matched", F.when(~F.col("matched"), F.col("stable_id")).alias("new_id"), "verdict", "digits", "stored_digits")


def _fields(ddl: str) -> str:
    return ", ".join(":".join(f.split()) for f in ddl.split(", "))


def merge_events(pairs: DataFrame) -> DataFrame:
    """When which id is merged into which: match_id, frame_idx, keep_id, drop_id.

    ``pairs``: match_id, frame_idx, a, b of ids on top of each other. In order of time the larger of the two ids
    that the ends then go by is dropped for the smaller one. Only the first frame of each pair counts, so a match comes
    with one row per pair of its ids.
    """
    firsts = pairs.groupBy("match_id", "a", "b").agg(F.min("frame_idx").alias("frame_idx"))

    def merges(pdf: pd.DataFrame) -> pd.DataFrame:
        goes: dict[int, int] = {}

        def now(i: int) -> int:
            while goes.get(i, i) != i:
                i = goes[i] = goes.get(goes[i], goes[i])
            return i

        out = []
        for frame, a, b in sorted(zip(pdf["frame_idx"], pdf["a"], pdf["b"])):
            keep, drop = sorted((now(a), now(b)))
            if keep != drop:
                goes[drop] = keep
                out.append((pdf["match_id"].iloc[0], frame, keep, drop))
        return pd.DataFrame(out, columns=["match_id", "frame_idx", "keep_id", "drop_id"])

    return firsts.groupBy("match_id").applyInPandas(merges, "match_id string, frame_idx bigint, keep_id bigint, drop_id bigint")


def expired_ids(spans: DataFrame, ends: DataFrame, ttl: int, every: int = EXPIRY_EVERY, size: int = FRAME_BUCKET) -> DataFrame:
    """Frame at which an id is forgotten: match_id, stable_id, last_seen, expired_at.

    ``spans``: match_id, stable_id, first, last of its raw tracks, which do not overlap. Looked at every ``every`` frames
    and once after the last one (``ends``: match_id, n_frames).
    """
    key = ["match_id", "stable_id"]
    seen = scan(spans.select(*key, "first", "last"), key, frame_bucket("first", size), ["first"], {"_next": following(F.col("first"))})
    check = (F.ceil((F.col("last") + ttl + 1) / F.lit(every)) * every).cast("long")
    timed = seen.withColumn("_check", check).join(ends, "match_id")
    alone = F.col("_next").isNull()
    at = F.when((F.col("_check") < F.col("n_frames")) & (alone | (F.col("_check") < F.col("_next"))), F.col("_check"))
    at = F.coalesce(at, F.when(alone & (F.col("n_frames") - F.col("last") > ttl), F.col("n_frames")))
    return timed.select(*key, F.col("last").alias("last_seen"), at.alias("expired_at")).filter("expired_at IS NOT NULL")


def full_log(decisions: DataFrame, merges: DataFrame, expired: DataFrame) -> DataFrame:
    """All rows of the decision log: checks, vetoes and new tracks, merged duplicates, forgotten galleries."""
    high, checked, told = F.col("event") == "reid_high_conf", F.col("event") == "reid_vlm_checked", F.col("event").isNotNull()
    null = {"matched_stable_id": "bigint", "candidate_stable_id": "bigint", "similarity": "double", "vlm_used": "boolean", "vlm_verdict": "boolean", "vlm_raw_text": "string", "ocr_candidate_digits": "string", "ocr_stored_digits": "string"}

    def row(event, **given):
        return F.struct(event.alias("event"), *[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in null.items()])

    candidate = F.col("candidate_id")
    rows = F.array_compact(
        F.array(
            F.when(told, row(F.col("event"), matched_stable_id=F.when(high, candidate), candidate_stable_id=F.when(~high, candidate), similarity=F.col("similarity"), vlm_used=F.when(checked, True), vlm_verdict=F.when(checked, F.col("verdict")))),
            F.when(F.col("vetoed"), row(F.lit("ocr_veto"), candidate_stable_id=candidate, ocr_candidate_digits=F.col("digits"), ocr_stored_digits=F.col("stored_digits"))),
            F.when(F.col("new_id").isNotNull(), row(F.lit("new_track"), matched_stable_id=F.col("new_id"))),
        )
    )
    made = decisions.select("match_id", F.col("frame_idx").alias("frame"), F.col("raw_id").cast("long").alias("raw_id"), F.explode(rows).alias("r"))
    dropped = merges.select("match_id", F.col("frame_idx").alias("frame"), F.lit(None).cast("long").alias("raw_id"), row(F.lit("duplicate_merge"), matched_stable_id=F.col("keep_id"), candidate_stable_id=F.col("drop_id")).alias("r"))
    forgotten = expired.select("match_id", F.col("expired_at").alias("frame"), F.lit(None).cast("long").alias("raw_id"), row(F.lit("gallery_expired"), matched_stable_id=F.col("stable_id")).alias("r"))
    return made.unionByName(dropped).unionByName(forgotten).select("match_id", "frame", "r.event", "raw_id", *[f"r.{n}" for n in null])


def vote_counts(votes: DataFrame) -> DataFrame:
    """Votes per track and team with the first frame of each: match_id, track_id, team_id, n, since."""
    return votes.filter("team_id IS NOT NULL").groupBy(*TRACK, "team_id").agg(F.count("*").alias("n"), F.min("frame_idx").alias("since"))


def _kept(summary: DataFrame, merged: DataFrame) -> DataFrame:
    """Summary rows under their surviving id; ``merged`` has match_id, track_id, keep_id."""
    return summary.join(dealt(merged), TRACK, "left").withColumn("track_id", F.coalesce("keep_id", "track_id")).drop("keep_id")


def merged_votes(counts: DataFrame, merged: DataFrame) -> DataFrame:
    """Counts of ``vote_counts`` after merging, without going back to the boxes."""
    return _kept(counts, merged).groupBy(*TRACK, "team_id").agg(F.sum("n").alias("n"), F.min("since").alias("since"))


def voted_team(counts: DataFrame) -> DataFrame:
    """Most voted team per track, the one voted first on ties."""
    return counts.groupBy(*TRACK).agg(F.max_by("team_id", F.struct("n", -F.col("since"))).alias("team_id"))


def merged_gallery(shots: DataFrame, merged: DataFrame, most: int = GALLERY_SHOTS) -> DataFrame:
    """Sharpest crops after merging, from the galleries of the tracks."""
    w = Window.partitionBy(*TRACK).orderBy(F.col("sharpness").desc(), "arrival")
    return _kept(shots.drop("slot"), merged).withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= most)


def merged_numbers(numbers: DataFrame, merged: DataFrame) -> DataFrame:
    """Most confident number after merging, that of the smaller id on ties."""
    order = F.struct(F.col("ocr_conf"), -F.col("_was"))
    best = F.max_by(F.struct("digits", "ocr_conf"), order)
    return _kept(numbers.withColumn("_was", F.col("track_id")), merged).groupBy(*TRACK).agg(best.alias("r")).select(*TRACK, "r.digits", "r.ocr_conf")
