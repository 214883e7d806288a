"""Tracks: gaps, votes, galleries, duplicates and re-identification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import geometry as geo
from touchline.operators.joins import dealt
from touchline.operators.scans import FRAME_BUCKET, first_seen, following, frame_bucket, number_rows, previous, running_sum, scan
from touchline.session import durable

TRACK = ["match_id", "track_id"]
FRAME = ["match_id", "frame_idx"]
# fixed values
SIM_HIGH, SIM_LOW = 0.85, 0.65
GALLERY_SHOTS, MIN_CROP_PX, BLUR_BAR, OCR_BAR = 5, 32, 80.0, 0.75
DUPLICATE_IOU, MATCH_IOU = 0.6, 0.3
EXPIRY_EVERY = 30
FEW_PLAYERS = 6
CELL_PX = 128


def gaps(sightings: DataFrame, fps: Column | float, buffer_frames: Column | int, size: int = FRAME_BUCKET) -> DataFrame:
    """Pauses of a track: last frame before, first after, length, near the buffer limit."""
    seen = scan(sightings, TRACK, frame_bucket(size=size), ["frame_idx"], {"from_frame": previous(F.col("frame_idx"))})
    gap = F.col("frame_idx") - F.col("from_frame")
    return seen.filter(gap > 1).select(
        *TRACK,
        "from_frame",
        F.col("frame_idx").alias("to_frame"),
        gap.alias("gap"),
        (gap / F.lit(fps)).alias("gap_s"),
        (gap > F.lit(buffer_frames) * 0.8).alias("near_limit"),
    )


def longest_gaps(found: DataFrame, n: int = 20) -> DataFrame:
    w = Window.partitionBy("match_id").orderBy(F.col("gap").desc(), "track_id", "from_frame")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def detection_probe(frames: DataFrame, detections: DataFrame, first_n: int | None = None) -> DataFrame:
    """Fewest, most and mean detections over all or the first frames, empty ones included."""
    if first_n is not None:
        frames, detections = (df.filter(F.col("frame_idx") < first_n) for df in (frames, detections))
    counts = detections.groupBy(*FRAME).agg(F.count("*").alias("n"))
    per = frames.select(*FRAME).join(dealt(counts), FRAME, "left").fillna(0, ["n"])
    out = per.groupBy("match_id").agg(F.min("n").alias("fewest"), F.max("n").alias("most"), F.avg("n").alias("mean"))
    return out.withColumn("too_few", F.col("most") < FEW_PLAYERS)


def majority_team(votes: DataFrame) -> DataFrame:
    """Most voted team per track; on ties the team voted first; 0 without a vote."""
    counts = votes.filter(F.col("team_id").isNotNull()).groupBy(*TRACK, "team_id").agg(F.count("*").alias("n"), F.min("frame_idx").alias("since"))
    best = counts.groupBy(*TRACK).agg(F.max_by("team_id", F.struct("n", -F.col("since"))).alias("team_id"))
    known = votes.select(*TRACK).distinct()
    return known.join(best, TRACK, "left").fillna(0, ["team_id"])


def running_team(votes: DataFrame, size: int = FRAME_BUCKET) -> DataFrame:
    """Team of a track as far as known at every frame."""
    out = {
        "_n0": running_sum(F.when(F.col("team_id") == 0, 1)),
        "_n1": running_sum(F.when(F.col("team_id") == 1, 1)),
        "_first": first_seen(F.col("team_id")),
    }
    seen = scan(votes, TRACK, frame_bucket(size=size), ["frame_idx"], out)
    team = F.when(F.col("_n0") > F.col("_n1"), 0).when(F.col("_n1") > F.col("_n0"), 1).otherwise(F.coalesce("_first", F.lit(0)))
    return seen.select(*votes.columns, team.cast("int").alias("team_so_far"))


def gallery(crops: DataFrame, shots: int = GALLERY_SHOTS) -> DataFrame:
    """Sharpest crops per track that pass the size and blur bars, earlier ones on ties.

    The rank filter also runs before the shuffle, so each task sends few rows per track.
    """
    good = crops.filter((F.least("crop_w", "crop_h") >= MIN_CROP_PX) & (F.col("sharpness") >= BLUR_BAR))
    w = Window.partitionBy(*TRACK).orderBy(F.col("sharpness").desc(), "arrival")
    return good.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= shots)


def best_number(crops: DataFrame) -> DataFrame:
    """Most confident shirt number per track: digits only, from the confidence bar up."""
    digits = F.regexp_replace("ocr_text", r"[^0-9]", "")
    reads = crops.withColumn("digits", digits).filter((F.col("digits") != "") & (F.col("ocr_conf") >= OCR_BAR))
    best = F.max_by(F.struct("digits", "ocr_conf"), F.struct(F.col("ocr_conf"), -F.col("arrival")))
    return reads.groupBy(*TRACK).agg(best.alias("r")).select(*TRACK, "r.digits", "r.ocr_conf")


def with_cells(boxes: DataFrame, x1: str, y1: str, x2: str, y2: str) -> DataFrame:
    """One row per grid cell (gx, gy) a box touches; a few per box."""

    def cell(c: str) -> Column:
        return F.floor(F.col(c) / CELL_PX).cast("int")

    columns = boxes.withColumn("gx", F.explode(F.sequence(cell(x1), F.greatest(cell(x1), cell(x2)))))
    return columns.withColumn("gy", F.explode(F.sequence(cell(y1), F.greatest(cell(y1), cell(y2)))))


def overlap(a: str, b: str) -> Column:
    """IoU of the boxes whose columns start with ``a`` and ``b``."""
    return geo.iou(geo.box(a), geo.box(b))


def boxes_as(rows: DataFrame, prefix: str, *keep: Column | str) -> DataFrame:
    return rows.select(*FRAME, *keep, *[F.col(c).alias(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")])


def duplicate_pairs(boxes: DataFrame, bar: float = DUPLICATE_IOU) -> DataFrame:
    """Pairs a < b of one frame that overlap by at least ``bar``, which has to be above 0.

    Above one half two such boxes each hold the centre of the other, so one is spread over the cells
    it touches and met only by the boxes whose centre lies in them. Up to one half both are spread, and a pair is
    taken in the first cell that both touch.
    """
    if bar <= 0:
        raise ValueError("boxes that do not overlap share no cell")
    wide = with_cells(boxes_as(boxes, "p_", F.col("track_id").alias("a")), "p_x1", "p_y1", "p_x2", "p_y2")
    point = boxes_as(boxes, "q_", F.col("track_id").alias("b"))
    if bar > 0.5:
        point = point.withColumns(
            {
                "gx": F.floor((F.col("q_x1") + F.col("q_x2")) / 2 / CELL_PX).cast("int"),
                "gy": F.floor((F.col("q_y1") + F.col("q_y2")) / 2 / CELL_PX).cast("int"),
            }
        )
        once = F.lit(True)
    else:
        point = with_cells(point, "q_x1", "q_y1", "q_x2", "q_y2")
        once = (F.col("gx") == F.floor(F.greatest("p_x1", "q_x1") / CELL_PX)) & (F.col("gy") == F.floor(F.greatest("p_y1", "q_y1") / CELL_PX))
    joined = wide.join(dealt(point), [*FRAME, "gx", "gy"]).filter(F.expr("a < b") & once)
    return joined.select(*FRAME, "a", "b", overlap("p_", "q_").alias("iou")).filter(F.col("iou") >= bar)


def new_detections(detections: DataFrame, active: DataFrame, bar: float = MATCH_IOU) -> DataFrame:
    """Detections whose best overlap with any active track of the frame is below ``bar``.

    Boxes are dealt once, by frame, one row each: spread over cells they would be shuffled several times over, and
    a frame holds few boxes.
    """
    known = active.select(*[F.col(c).alias(f"q_{c}") for c in FRAME], *[F.col(c).alias(f"q_{c}") for c in ("x1", "y1", "x2", "y2")])
    same = [F.col(c) == F.col(f"q_{c}") for c in FRAME]
    touch = [F.col(f"{i}1") < F.col(f"q_{i}2") for i in "xy"] + [F.col(f"q_{i}1") < F.col(f"{i}2") for i in "xy"]
    # rows keep apart even where a frame repeats a det_id
    rows = detections.withColumn("_row", F.monotonically_increasing_id())
    pairs = rows.join(dealt(known), [*same, *touch], "left")
    rest = [c for c in detections.columns if c not in (*FRAME, "det_id")]
    met = pairs.groupBy(*FRAME, "det_id", "_row").agg(F.max(overlap("", "q_")).alias("_iou"), *[F.first(c).alias(c) for c in rest])
    best = F.coalesce(F.max("_iou").over(Window.partitionBy(*FRAME, "det_id")), F.lit(0.0))
    return met.withColumn("best_iou", best).filter(F.col("best_iou") < bar).select(*detections.columns, "best_iou")


def merge_ids(pairs: DataFrame) -> DataFrame:
    """Smallest id of every group of linked tracks: rows (match_id, track_id, keep_id).

    Labels spread over the distinct links and jump to the label of their label, so the
    number of rounds grows with the logarithm of the longest chain. Links and labels have a row per
    track of every match, so the rounds deal them by key.
    """
    links = pairs.select("match_id", "a", "b").distinct()
    both = durable(links.unionByName(links.select("match_id", F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = both.groupBy("match_id", F.col("a").alias("track_id")).agg(F.least(F.min("b"), F.col("track_id")).alias("keep_id"))
    labels = durable(labels)
    while True:
        near = both.join(dealt(labels.select("match_id", F.col("track_id").alias("b"), "keep_id")), ["match_id", "b"])
        near = near.groupBy("match_id", F.col("a").alias("track_id")).agg(F.min("keep_id").alias("_near"))
        up = labels.select("match_id", F.col("track_id").alias("keep_id"), F.col("keep_id").alias("_up"))
        step = labels.join(dealt(near), TRACK, "left").join(dealt(up), ["match_id", "keep_id"], "left")
        new = durable(
            step.select(*TRACK, F.least("keep_id", "_near", "_up").alias("keep_id"), F.col("keep_id").alias("_was"))
        )
        labels = new.drop("_was")
        if new.filter("keep_id <> _was").isEmpty():
            return labels


def remap(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows under their surviving track id."""
    joined = rows.join(merged, TRACK, "left")
    return joined.withColumn("track_id", F.coalesce("keep_id", "track_id")).select(*rows.columns)


def surviving_tracks(tracks: DataFrame, merged: DataFrame) -> DataFrame:
    gone = merged.filter("track_id <> keep_id").select(*TRACK)
    return tracks.join(dealt(gone), TRACK, "left_anti")


def reid_candidates(arrivals: DataFrame, lost: DataFrame, long_gap: int, ttl: int) -> DataFrame:
    """Best lost track for every new one: (match_id, frame_idx, raw_id, candidate_id, similarity).

    ``arrivals``: match_id, frame_idx, raw_id, embedding. ``lost``: match_id, stable_id,
    last_seen, embedding, one row per gallery shot. Only tracks unseen for more than
    ``long_gap`` and at most ``ttl`` frames count. Time is cut into slices of ``ttl``
    frames; a new track meets its own slice and the one before.
    """

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    slice_ = F.floor(F.col("frame_idx") / ttl).cast("long")
    new = arrivals.select(*FRAME, "raw_id", F.col("embedding").alias("p"), norm(F.col("embedding")).alias("np"),
                          F.explode(F.array(slice_, slice_ - 1)).alias("_slice"))
    old = lost.select("match_id", "stable_id", "last_seen", F.col("embedding").alias("q"), norm(F.col("embedding")).alias("nq"),
                      F.floor(F.col("last_seen") / ttl).cast("long").alias("_slice"))
    gap = F.col("frame_idx") - F.col("last_seen")
    pairs = new.join(old, ["match_id", "_slice"]).filter((gap > long_gap) & (gap <= ttl))
    products = F.zip_with("p", "q", lambda x, y: x.cast("double") * y.cast("double"))
    sim = F.aggregate(products, F.lit(0.0), lambda s, x: s + x) / (F.col("np") * F.col("nq") + F.lit(1e-8))
    best = pairs.select(*FRAME, "raw_id", "stable_id", sim.alias("sim")).groupBy(*FRAME, "raw_id").agg(
        F.max(F.struct(F.col("sim"), (-F.col("stable_id")).alias("back"))).alias("m")
    )
    found = best.select(*FRAME, "raw_id", (-F.col("m.back")).alias("candidate_id"), F.col("m.sim").alias("similarity"))
    return arrivals.select(*FRAME, "raw_id").join(dealt(found), [*FRAME, "raw_id"], "left")


def reid_decisions(proposals: DataFrame, size: int = FRAME_BUCKET) -> DataFrame:
    """Outcome of every proposal: matched to its lost track, or a new id.

    ``proposals``: match_id, frame_idx, raw_id, candidate_id, similarity, verdict (of the
    outside check, null when there was none), digits (read now), stored_digits. In the
    ambiguous band the verdict decides; two different numbers veto. In a frame a lost
    track goes to the most similar proposal that passes; others get new ids, numbered
    in order of frame and falling similarity.
    """
    sim = F.coalesce("similarity", F.lit(-1.0))
    band = (sim >= SIM_LOW) & (sim < SIM_HIGH)
    passes = (sim >= SIM_HIGH) | (band & F.coalesce("verdict", F.lit(False)))
    veto = F.col("digits").isNotNull() & F.col("stored_digits").isNotNull() & (F.col("digits") != F.col("stored_digits"))
    tested = proposals.withColumns(
        {
            "_sim": sim,
            "_ok": F.col("candidate_id").isNotNull() & passes & ~veto,
            "_veto": F.col("candidate_id").isNotNull() & passes & veto,
            "_band": band,
        }
    )
    # a frame holds a handful of new tracks
    order = Window.partitionBy(*FRAME).orderBy(F.col("_sim").desc(), "raw_id")
    rival = Window.partitionBy(*FRAME, "candidate_id").orderBy(F.col("_sim").desc(), "raw_id")
    won_before = F.coalesce(F.sum(F.col("_ok").cast("int")).over(rival.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = tested.withColumns({"_place": F.row_number().over(order), "_taken": won_before > 0})
    matched = F.col("_ok") & ~F.col("_taken")
    event = (
        F.when(F.col("candidate_id").isNull() | F.col("_taken"), F.lit(None).cast("string"))
        .when(F.col("_sim") >= SIM_HIGH, "reid_high_conf")
        .when(F.col("_band") & F.col("verdict").isNull(), "reid_vlm_skipped_no_ref")
        .when(F.col("_band"), "reid_vlm_checked")
        .otherwise("reid_below_threshold")
    )
    done = ranked.withColumns({"matched": matched, "event": event, "vetoed": F.col("_veto") & ~F.col("_taken")})
    fresh = number_rows(done.filter(~F.col("matched")), ["match_id"], frame_bucket(size=size), ["frame_idx", "_place"], "new_id")
    cols = [*FRAME, "raw_id", "candidate_id", "similarity", "event", "vetoed", "matched"]
    return fresh.select(*cols, "new_id").unionByName(done.filter("matched").select(*cols, F.lit(None).cast("long").alias("new_id")))


def reid_log(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decision log rows: the check, a veto, and a new track, each on its own row."""
    both = decisions.join(dealt(proposals.select(*FRAME, "raw_id", "verdict", "digits", "stored_digits")), [*FRAME, "raw_id"])
    high = F.col("event") == "reid_high_conf"
    checked = F.col("event") == "reid_vlm_checked"
    null_s, null_l, null_b = (F.lit(None).cast(t) for t in ("string", "long", "boolean"))

    def row(event, matched=null_l, candidate=null_l, similarity=F.lit(None).cast("double"), used=null_b, verdict=null_b, d=null_s, s=null_s):
        return F.struct(
            event.alias("event"), matched.alias("matched_stable_id"), candidate.alias("candidate_stable_id"), similarity.alias("similarity"),
            used.alias("vlm_used"), verdict.alias("vlm_verdict"), null_s.alias("vlm_raw_text"), d.alias("ocr_candidate_digits"), s.alias("ocr_stored_digits"),
        )

    cand = F.col("candidate_id").cast("long")
    rows = F.array_compact(
        F.array(
            F.when(
                F.col("event").isNotNull(),
                row(F.col("event"), F.when(high, cand), F.when(~high, cand), F.col("similarity"), F.when(checked, True), F.when(checked, F.col("verdict"))),
            ),
            F.when(F.col("vetoed"), row(F.lit("ocr_veto"), candidate=cand, d=F.col("digits"), s=F.col("stored_digits"))),
            F.when(F.col("new_id").isNotNull(), row(F.lit("new_track"), matched=F.col("new_id"))),
        )
    )
    return both.select("match_id", F.col("frame_idx").alias("frame"), "raw_id", F.explode(rows).alias("r")).select(
        "match_id", "frame", "r.event", "raw_id", *[f"r.{c}" for c in ("matched_stable_id", "candidate_stable_id", "similarity", "vlm_used", "vlm_verdict", "vlm_raw_text", "ocr_candidate_digits", "ocr_stored_digits")]
    )


def gallery_expiry(sightings: DataFrame, ends: DataFrame, ttl: int, every: int = EXPIRY_EVERY, size: int = FRAME_BUCKET) -> DataFrame:
    """Frame at which a track unseen for more than ``ttl`` frames is forgotten.

    Checked every ``every`` frames and once after the last frame (``ends``: match_id,
    n_frames); a track seen again before the check stays.
    """
    seen = scan(sightings.select(*TRACK, "frame_idx"), TRACK, frame_bucket(size=size), ["frame_idx"], {"_next": following(F.col("frame_idx"))})
    check = (F.ceil((F.col("frame_idx") + ttl + 1) / F.lit(every)) * every).cast("long")
    timed = seen.withColumn("_check", check).join(ends, "match_id")
    final = (F.col("n_frames") - F.col("frame_idx") > ttl) & F.col("_next").isNull()
    at = F.when((F.col("_check") < F.col("n_frames")) & (F.col("_next").isNull() | (F.col("_check") < F.col("_next"))), F.col("_check")).when(final, F.col("n_frames"))
    return timed.withColumn("expired_at", at).filter("expired_at IS NOT NULL").select(*TRACK, F.col("frame_idx").alias("last_seen"), "expired_at")


def track_rows(boxes: DataFrame, teams: DataFrame, fps: Column | float) -> DataFrame:
    """Rows of the track file: boxes to one decimal, the voted team, seconds."""
    named = boxes.join(teams.select(*TRACK, "team_id"), TRACK, "left").fillna(0, ["team_id"])
    return named.select(
        "match_id",
        F.col("frame_idx").alias("frame"),
        (F.col("frame_idx") / F.lit(fps)).alias("timestamp_s"),
        "track_id",
        F.col("team_id").alias("team"),
        *[F.round(F.col(c).cast("double"), 1).alias(c) for c in ("x1", "y1", "x2", "y2")],
        "confidence",
    )
