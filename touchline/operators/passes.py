"""Passes: one state machine per match, and the minute counters it leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import counters as cnt
from touchline.operators import minutes as mn
from touchline.operators.folds import fold
from touchline.operators.joins import dealt
from touchline.operators.scans import FRAME_BUCKET, frame_bucket, minute_bucket, previous, scan, running_sum
from touchline.session import durable

# fixed values: phases, labels, events
IDLE, HOLDING, LEAVING, TRAVEL, CATCHING = "idle", "in_possession", "candidate_release", "travel", "candidate_reception"
MOVING = (LEAVING, TRAVEL, CATCHING)
TEAM_LABEL = {0: "team_a", 1: "team_b"}
COMPLETED, INTERCEPTION, BALL_LOST = "completed", "interception", "ball_lost"

PASS_INPUTS = ["kind", "track_id", "team_id", "release_sustain", "reception_settle", "travel_min_gap", "travel_timeout_frames"]
PASS_START = (IDLE, None, None, None, None, -1, -1, -1, 0)
PASS_OUTPUT = (
    "label string, phase string, event string, from_track bigint, from_team int, to_track bigint, to_team int, "
    "release_frame bigint, travel_frames int, adj_kind string, adj_team int, adj_n int, travel int, "
    "giver bigint, giver_team int, taker bigint, taker_team int"
)


def next_move(phase, carried, back, taken, left, gone, caught, rules) -> str:
    """What the ball does this frame.

    ``carried``: somebody has it; ``back``: it is the passer; ``taken``: it is the
    receiver on trial. ``left``, ``gone``, ``caught`` count frames since then.
    """
    sustain, settle, gap, timeout = rules
    if phase == IDLE:
        return "take" if carried else "stay"
    if phase == HOLDING:
        return "stay" if back else "leave"
    if phase == LEAVING:
        return "return" if back else "release" if left >= sustain else "stay"
    if phase == CATCHING:
        if taken:
            return "resolve" if caught >= settle else "stay"
        return "catch" if carried and not back and gone >= gap else "drop"
    if gone > timeout:
        return "lose"
    if back:
        return "return"
    return "catch" if carried and gone >= gap else "stay"


def pass_step(state: tuple, f: int, row: tuple) -> tuple[tuple, tuple]:
    """One frame. State: phase, passer, its team, receiver, its team, three frame marks,
    frames credited to the passer while the ball is on its way."""
    phase, giver, giver_team, taker, taker_team, left_at, gone_at, caught_at, travel = state
    kind, track, team, *rules = row
    carried = kind == "carrier"
    move = next_move(
        phase, carried, carried and track == giver, carried and track == taker,
        f - left_at, f - gone_at, f - caught_at, rules,
    )

    event = origin = origin_team = target = target_team = release = spent = None
    adj_kind = adj_team = adj_n = None
    if move in ("resolve", "lose"):
        origin, origin_team, release, spent = giver, giver_team, gone_at, travel
        if move == "lose":
            event, fix = BALL_LOST, ("drop", giver_team, travel)
        else:
            target, target_team = taker, taker_team
            event, fix = (COMPLETED, None) if taker_team == giver_team else (INTERCEPTION, ("flip_to", taker_team, travel))
        if fix and travel:
            adj_kind, adj_team, adj_n = fix

    if move == "take":
        phase, giver, giver_team = HOLDING, track, team
    elif move == "leave":
        phase, left_at, travel = LEAVING, f, 0
    elif move == "release":
        phase, gone_at = TRAVEL, f
    elif move == "catch":
        phase, taker, taker_team, caught_at = CATCHING, track, team, f
    elif move == "drop":
        phase, taker, taker_team = TRAVEL, None, None
    elif move == "resolve":
        phase, giver, giver_team = HOLDING, taker, taker_team
    elif move == "return":
        phase = HOLDING
    elif move == "lose":
        phase, giver, giver_team = IDLE, None, None
    if move in ("take", "return", "resolve", "lose"):
        taker = taker_team = None
        left_at = gone_at = caught_at = -1
        travel = 0
    if phase in MOVING:
        travel += 1

    if phase == HOLDING:
        label = "team_a" if giver_team == 0 else "team_b"
    else:
        idle = "loose" if kind == "loose" else "oof"
        label = TEAM_LABEL.get(giver_team, idle) if phase in MOVING else idle
    state = (phase, giver, giver_team, taker, taker_team, left_at, gone_at, caught_at, travel)
    return state, (
        label, phase, event, origin, origin_team, target, target_team, release, spent,
        adj_kind, adj_team, adj_n, travel, giver, giver_team, taker, taker_team,
    )


def run_passes(carriers: DataFrame, size: int = FRAME_BUCKET, warmup: int = 256) -> DataFrame:
    """State machine over every frame of every match.

    ``carriers``: match_id, frame_idx and ``PASS_INPUTS``. Clip boundaries play no part.
    """
    return fold(carriers, ["match_id"], "frame_idx", PASS_INPUTS, pass_step, PASS_START, PASS_OUTPUT, size=size, warmup=warmup)


def pass_events(steps: DataFrame) -> DataFrame:
    """Resolved passes."""
    return steps.filter(F.col("event").isNotNull()).select(
        "match_id", F.col("event").alias("kind"), "from_track", "from_team", "to_track", "to_team", "release_frame",
        F.col("frame_idx").alias("end_frame"), "travel_frames",
    )


def adjustments(steps: DataFrame) -> DataFrame:
    """Frames whose credit an interception or a lost ball changes afterwards."""
    return steps.filter(F.col("adj_kind").isNotNull()).select(
        "match_id", "frame_idx", F.col("adj_kind").alias("kind"), F.col("adj_team").alias("team_id"), F.col("adj_n").alias("frames")
    )


def transitions(steps: DataFrame, size: int = FRAME_BUCKET) -> DataFrame:
    """Log of phase changes worth a line, with the tracks involved."""
    seen = scan(steps, ["match_id"], frame_bucket(size=size), ["frame_idx"], {"_before": previous(F.col("phase"))})
    was, now = F.coalesce("_before", F.lit(IDLE)), F.col("phase")
    text = (
        F.when((now == HOLDING) & (was == IDLE), "NEW CARRIER")
        .when(now == LEAVING, "CAND RELEASE")
        .when((now == TRAVEL) & (was == LEAVING), "RELEASE CONFIRMED")
        .when(now == CATCHING, "CAND RECEPTION")
        .when((now == TRAVEL) & (was == CATCHING), "RECEPTION DROPPED")
    )
    rows = seen.filter(was != now).withColumn("message", text).filter(F.col("message").isNotNull())
    return rows.select("match_id", "frame_idx", "message", "giver", "giver_team", "taker", "taker_team")


def assign_clips(events: DataFrame, clips: DataFrame, size: int = FRAME_BUCKET) -> DataFrame:
    """Clip whose frame range holds ``end_frame``.

    Clip ranges are cut at frame buckets, so that the range test runs within
    (match, bucket) instead of over all clips of a match.
    """
    first, last = (F.floor(F.col(c) / F.lit(size)).cast("long") for c in ("first_frame", "last_frame"))
    pieces = clips.select("match_id", "half", "minute", "first_frame", "last_frame", F.explode(F.sequence(first, last)).alias("_piece"))
    placed = events.withColumn("_piece", frame_bucket("end_frame", size))
    joined = placed.join(pieces, ["match_id", "_piece"])
    return joined.filter(F.col("end_frame").between(F.col("first_frame"), F.col("last_frame"))).drop("_piece", "first_frame", "last_frame")


def minute_rows(steps: DataFrame, strict_carryover: bool = False) -> DataFrame:
    """Raw counters per clip from the frames of ``run_passes`` joined with half and minute.

    An adjustment acts on the counters of its own minute as they stand at that frame.
    Frames already credited in the minute before (the pass began there) come first and
    become a correction of that minute; a second one in the same clip is dropped. With
    ``strict_carryover`` only the pass that spans the boundary may reach back.

    Columns: clip, ten counters, corr_half, corr_minute, corr_kind, corr_team, corr_frames.
    """
    clip = mn.CLIP
    sofar = Window.partitionBy(*clip).orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    names = {"a": "team_a", "b": "team_b", "oof": "oof"}
    counted = steps.withColumns({f"_{k}": F.count_if(F.col("label") == v).over(sofar) for k, v in names.items()})
    moving = F.col("phase").isin(*MOVING)
    counted = counted.withColumn("_settled", F.min(F.when(~moving, F.col("frame_idx"))).over(sofar))
    fix = F.struct("frame_idx", "_a", "_b", "_oof", F.col("adj_kind").alias("kind"), F.col("adj_team").alias("team"),
                   F.col("adj_n").alias("n"), (F.col("_settled") == F.col("frame_idx")).alias("first"))
    events = {"completed": "passes_completed", "interception": "interceptions", "ball_lost": "ball_lost"}
    per_clip = counted.groupBy(*clip).agg(
        *[F.count_if(F.col("label") == lab).alias(f"frames_{lab}") for lab in ("team_a", "team_b", "loose", "oof")],
        *[
            F.count_if((F.col("event") == kind) & (F.col("from_team") == t)).cast("int").alias(f"{name}_{side}")
            for kind, name in events.items()
            for t, side in ((0, "team_a"), (1, "team_b"))
        ],
        F.sort_array(F.collect_list(F.when(F.col("adj_kind").isNotNull(), fix))).alias("_fixes"),
        F.max_by(F.when(moving, F.col("travel")).otherwise(F.lit(0)), "frame_idx").alias("_tail"),
    )
    before = {"_carry": previous(F.col("_tail")), "_half": previous(F.col("half")), "_minute": previous(F.col("minute"))}
    chained = scan(per_clip, ["match_id"], minute_bucket(), ["half", "minute"], before)
    done = chained.withColumn("_end", _account(F.col("_fixes"), F.coalesce("_carry", F.lit(0)), F.col("_half").isNotNull(), strict_carryover))
    corrected = F.col("_end.ck").isNotNull()
    deltas = {"frames_team_a": "a", "frames_team_b": "b", "frames_oof": "oof"}
    return done.select(
        *clip,
        *[(F.col(c) + (F.col(f"_end.{deltas[c]}") if c in deltas else F.lit(0))).cast("int").alias(c) for c in cnt.COUNTERS],
        F.when(corrected, F.col("_half")).alias("corr_half"),
        F.when(corrected, F.col("_minute")).alias("corr_minute"),
        F.col("_end.ck").alias("corr_kind"),
        F.col("_end.ct").cast("int").alias("corr_team"),
        F.col("_end.cn").cast("int").alias("corr_frames"),
    )


def _account(fixes: Column, carry: Column, has_previous: Column, strict: bool) -> Column:
    """Changes to a, b, oof and the correction, over the few adjustments of one clip."""
    whole = F.lit(0).cast("long")
    start = F.struct(
        whole.alias("a"), whole.alias("b"), whole.alias("oof"), carry.cast("long").alias("carry"),
        F.lit(None).cast("string").alias("ck"), F.lit(None).cast("long").alias("ct"), F.lit(None).cast("long").alias("cn"),
    )

    def apply(acc: Column, x: Column) -> Column:
        available = F.when(x["first"], acc["carry"]).otherwise(whole) if strict else acc["carry"]
        part = cnt.split_adjustment(x["n"].cast("long"), available)
        a, b, oof = x["_a"] + acc["a"], x["_b"] + acc["b"], x["_oof"] + acc["oof"]
        new = cnt.adjust(x["kind"], x["team"], part["current"], a, b, oof)
        owed = (part["prior"] > 0) & has_previous & acc["ck"].isNull()
        return F.struct(
            (new["a"] - x["_a"]).alias("a"),
            (new["b"] - x["_b"]).alias("b"),
            (new["oof"] - x["_oof"]).alias("oof"),
            part["rest"].cast("long").alias("carry"),
            F.when(owed, x["kind"]).otherwise(acc["ck"]).alias("ck"),
            F.when(owed, x["team"].cast("long")).otherwise(acc["ct"]).alias("ct"),
            F.when(owed, part["prior"].cast("long")).otherwise(acc["cn"]).alias("cn"),
        )

    return F.aggregate(fixes, start, apply)


def whole_match(steps: DataFrame, size: int = FRAME_BUCKET) -> DataFrame:
    """Counters of whole matches taken as one unit, half 1 and minute 1 without a duration.

    Without clip boundaries every adjustment acts in full on the counters of the match as they stand at its frame. Running
    sums give the counters as if no adjustment ever asked for more frames than there are; what the clamps take back is
    folded per bucket of frames from a guessed start, and the starts are the sums of what earlier buckets took back, so
    the rounds end when no start changes. Needs no window longer than a bucket.
    """
    n, kind, first = F.col("adj_n").cast("long"), F.col("adj_kind"), F.col("adj_team") == 0
    flip = kind == "flip_to"
    want_a = F.when(flip & first, n).when(flip | ((kind == "drop") & first), -n)
    want_b = F.when(flip & ~first, n).when(flip | ((kind == "drop") & ~first), -n)
    wanted = steps.withColumns({"_wa": F.coalesce(want_a, F.lit(0)), "_wb": F.coalesce(want_b, F.lit(0))})
    sums = {
        "_a": running_sum(F.when(F.col("label") == "team_a", 1).otherwise(0) + F.col("_wa")),
        "_b": running_sum(F.when(F.col("label") == "team_b", 1).otherwise(0) + F.col("_wb")),
    }
    counted = scan(wanted, ["match_id"], frame_bucket(size=size), ["frame_idx"], sums, keep_bucket=True)
    fix = F.struct("frame_idx", (F.col("_a") - F.col("_wa")).alias("a"), (F.col("_b") - F.col("_wb")).alias("b"), kind.alias("kind"), F.col("adj_team").alias("team"), n.alias("n"), "_wa", "_wb")
    key = ["match_id", "_bucket"]
    pieces = counted.where("adj_kind IS NOT NULL").groupBy(*key).agg(F.sort_array(F.collect_list(fix)).alias("fixes"))
    pieces = durable(pieces, "fixes")

    def apply(acc: Column, x: Column) -> Column:
        a, b = x["a"] + acc["a"], x["b"] + acc["b"]
        new = cnt.adjust(x["kind"], x["team"], x["n"], a, b, F.lit(0))
        more = F.when(x["kind"] == "drop", new["oof"] - x["n"]).otherwise(0)
        return F.struct((acc["a"] + new["a"] - a - x["_wa"]).alias("a"), (acc["b"] + new["b"] - b - x["_wb"]).alias("b"), (acc["o"] + more).alias("o"))

    zero = F.lit(0).cast("long")
    starts = pieces.select(*key, zero.alias("sa"), zero.alias("sb"))
    before = Window.partitionBy("match_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        begin = F.struct(F.col("sa").alias("a"), F.col("sb").alias("b"), zero.alias("o"))
        ended = pieces.join(starts, key).withColumn("_end", F.aggregate("fixes", begin, apply))
        deltas = ended.select(*key, "sa", "sb", (F.col("_end.a") - F.col("sa")).alias("da"), (F.col("_end.b") - F.col("sb")).alias("db"), F.col("_end.o").alias("do"))
        # one row per bucket
        found = durable(deltas.withColumns({"na": F.coalesce(F.sum("da").over(before), zero), "nb": F.coalesce(F.sum("db").over(before), zero)}), "starts")
        if found.where("na <> sa OR nb <> sb").isEmpty():
            break
        starts = found.select(*key, F.col("na").alias("sa"), F.col("nb").alias("sb"))
    taken = found.groupBy("match_id").agg(*[F.sum(c).alias(c) for c in ("da", "db", "do")])
    events = {"completed": "passes_completed", "interception": "interceptions", "ball_lost": "ball_lost"}
    total = wanted.groupBy("match_id").agg(
        (F.count_if(F.col("label") == "team_a") + F.sum("_wa")).alias("frames_team_a"),
        (F.count_if(F.col("label") == "team_b") + F.sum("_wb")).alias("frames_team_b"),
        F.count_if(F.col("label") == "loose").alias("frames_loose"),
        (F.count_if(F.col("label") == "oof") + F.coalesce(F.sum(F.when(kind == "drop", n)), zero)).alias("frames_oof"),
        *[F.count_if((F.col("event") == e) & (F.col("from_team") == t)).alias(f"{name}_{side}") for e, name in events.items() for t, side in ((0, "team_a"), (1, "team_b"))],
    )
    back = {"frames_team_a": "da", "frames_team_b": "db", "frames_oof": "do"}
    return total.join(taken, "match_id", "left").select(
        "match_id",
        F.lit(1).alias("half"),
        F.lit(1).alias("minute"),
        F.lit(0.0).alias("clip_duration_seconds"),
        *[(F.col(c) + F.coalesce(F.col(back[c]), zero) if c in back else F.col(c)).cast("long").alias(c) for c in cnt.COUNTERS],
    )


def corrections(rows: DataFrame) -> DataFrame:
    """Corrections of earlier minutes, keyed by the minute they act on."""
    return rows.filter(F.col("corr_kind").isNotNull()).select(
        "match_id", F.col("corr_half").alias("half"), F.col("corr_minute").alias("minute"), F.col("corr_kind").alias("kind"),
        F.col("corr_team").alias("team_id"), F.col("corr_frames").alias("frames"),
    )


def final_minutes(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Minute table after orientation and corrections.

    ``clusters``: team_a_cluster_id per clip. A row is turned by its own orientation, a
    correction by the one its target was written under.
    """
    raw = rows.select(*mn.CLIP, *cnt.COUNTERS).join(dealt(clusters.select(*mn.CLIP, "team_a_cluster_id")), mn.CLIP, "left")
    turned = mn.orient_rows(raw).drop("team_a_cluster_id").withColumn("revision", F.lit(0))
    fixes = corrections(rows).join(dealt(clusters.select(*mn.CLIP, "team_a_cluster_id")), mn.CLIP, "left")
    fixes = mn.orient_teams(fixes, ["team_id"], "team_a_cluster_id")
    return mn.apply_corrections(turned, fixes)
