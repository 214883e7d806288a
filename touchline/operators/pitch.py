"""Pitch keypoints, homographies and coverage."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import geometry as geo
from touchline.operators.joins import dealt
from touchline.operators.scans import FRAME_BUCKET, frame_bucket, last_seen, next_seen, scan

# fixed values: pitch size in metres and the place of each keypoint
PITCH_W, PITCH_H = 40.0, 20.0
KEYPOINTS = {
    0: (0.0, 10.0),
    1: (0.0, 20.0),
    2: (10.0, 20.0),
    3: (20.0, 20.0),
    4: (30.0, 20.0),
    5: (40.0, 20.0),
    6: (40.0, 10.0),
    7: (40.0, 0.0),
    8: (30.0, 0.0),
    9: (20.0, 0.0),
    10: (10.0, 0.0),
    11: (0.0, 0.0),
    12: (20.0, 10.0),
}
# fixed values
CONF_BAR, CORNER_BAR, CORNERS, NOT_ON_FLOOR = 0.50, 0.35, (1, 5, 7, 11), (0, 6)
MIN_POINTS, MIN_SPAN, MAX_COND, LONG_GAP_S = 4, PITCH_W * 0.3, 1e7, 3.0
FRAME = ["match_id", "frame_idx"]


def layout(spark: SparkSession) -> DataFrame:
    """The thirteen keypoints with world position and confidence bar."""
    rows = [(i, x, y, CORNER_BAR if i in CORNERS else CONF_BAR, i not in NOT_ON_FLOOR) for i, (x, y) in KEYPOINTS.items()]
    return spark.createDataFrame(rows, "idx int, wx double, wy double, bar double, on_floor boolean")


def with_world(keypoints: DataFrame) -> DataFrame:
    """World position of every keypoint of the layout."""
    return keypoints.join(F.broadcast(layout(keypoints.sparkSession)), "idx")


def usable(keypoints: DataFrame) -> DataFrame:
    """Keypoints good enough for a homography."""
    return with_world(keypoints).filter(F.col("on_floor") & (F.col("conf") >= F.col("bar")))


def eligibility(keypoints: DataFrame) -> DataFrame:
    """Per frame: points used, whether a solve is tried, and why not when too narrow."""
    n = F.count_if(F.col("on_floor") & (F.col("conf") >= F.col("bar"))).cast("int")
    x = F.when(F.col("on_floor") & (F.col("conf") >= F.col("bar")), F.col("wx"))
    per = with_world(keypoints).groupBy(*FRAME).agg(n.alias("n_used"), (F.max(x) - F.min(x)).alias("span"))
    enough = F.col("n_used") >= MIN_POINTS
    narrow = enough & (F.col("span") < MIN_SPAN)
    reason = F.when(narrow, F.format_string("x_span=%.1fm<%.0fm", "span", F.lit(MIN_SPAN))).otherwise("")
    return per.select(*FRAME, "n_used", (enough & ~narrow).alias("eligible"), reason.alias("skip_reason"))


def acceptance(eligible: DataFrame, solves: DataFrame) -> DataFrame:
    """Log row per frame: whether the solved matrix is kept, else why not.

    ``solves``: match_id, frame_idx, cond, inliers, h (nine doubles).
    """
    both = eligible.join(dealt(solves), FRAME, "left")
    found = F.col("eligible") & F.col("h").isNotNull()
    reason = (
        F.when(~F.col("eligible"), F.col("skip_reason"))
        .when(found & (F.col("cond") > MAX_COND), "singular")
        .when(found & (F.col("inliers") < MIN_POINTS), F.concat(F.lit("only "), F.col("inliers").cast("string"), F.lit(" inliers")))
        .otherwise("")
    )
    solved = found & (F.col("cond") <= MAX_COND) & (F.col("inliers") >= MIN_POINTS)
    return both.select(*FRAME, "n_used", solved.alias("solved"), reason.alias("skip_reason"), F.when(solved, F.col("h")).alias("h"))


def fill_homographies(log: DataFrame, fps: Column | float, size: int = FRAME_BUCKET) -> DataFrame:
    """Matrix of every frame: its own, a blend of its neighbours, or a copy at the ends.

    Adds ``source`` (direct, before, after, blend), the neighbour frames, and ``long_gap``.
    """
    known = F.when(F.col("solved"), F.struct("frame_idx", "h"))
    near = scan(log, ["match_id"], frame_bucket(size=size), ["frame_idx"], {"_prev": last_seen(known), "_next": next_seen(known)})
    prev, nxt, here = F.col("_prev"), F.col("_next"), F.col("frame_idx")
    gap = nxt["frame_idx"] - prev["frame_idx"]
    source = (
        F.when(F.col("solved"), "direct")
        .when(prev.isNull() & nxt.isNull(), None)
        .when(prev.isNull(), "after")
        .when(nxt.isNull(), "before")
        .otherwise("blend")
    )
    weight = (here - prev["frame_idx"]) / gap
    filled = (
        F.when(source == "direct", F.col("h"))
        .when(source == "after", nxt["h"])
        .when(source == "before", prev["h"])
        .when(source == "blend", geo.blend(prev["h"], nxt["h"], weight))
    )
    return near.select(
        *[c for c in log.columns if c != "h"],
        source.alias("source"),
        prev["frame_idx"].alias("prev_frame"),
        nxt["frame_idx"].alias("next_frame"),
        ((source == "blend") & (gap > F.lit(fps) * LONG_GAP_S)).alias("long_gap"),
        filled.alias("h"),
    )


def reprojection(keypoints: DataFrame, log: DataFrame) -> DataFrame:
    """Pixel error of every used keypoint under the matrix of its frame."""
    solved = log.filter("solved").select(*FRAME, geo.inverse(F.col("h")).alias("_inv"))
    joined = usable(keypoints).join(dealt(solved), FRAME)
    back = joined.withColumn("_p", geo.project(F.col("_inv"), F.col("wx"), F.col("wy")))
    err = F.hypot(F.col("px") - F.col("_p.x"), F.col("py") - F.col("_p.y"))
    return back.select(*FRAME, "idx", "px", "py", F.col("_p.x").alias("reproj_x"), F.col("_p.y").alias("reproj_y"), err.alias("error_px"))


def solve_summary(filled: DataFrame) -> DataFrame:
    """Frames, direct and filled matrices per match."""
    return filled.groupBy("match_id").agg(
        F.count("*").alias("frames"),
        F.count_if(F.col("solved")).alias("direct"),
        F.count_if(~F.col("solved") & F.col("source").isNotNull()).alias("interpolated"),
        F.count_if(F.col("long_gap")).alias("long_gaps"),
    )


def skip_counts(log: DataFrame) -> DataFrame:
    """Frames per skip reason with its rank, most frequent first."""
    counts = log.filter(F.col("skip_reason") != "").groupBy("match_id", "skip_reason").agg(F.count("*").alias("n"))
    # a match has a handful of reasons
    w = Window.partitionBy("match_id").orderBy(F.col("n").desc(), "skip_reason")
    return counts.withColumn("rank", F.row_number().over(w))


def used_histogram(log: DataFrame) -> DataFrame:
    return log.groupBy("match_id", "n_used").agg(F.count("*").alias("frames"), F.count_if(F.col("solved")).alias("solved"))


def best_frames(log: DataFrame, n: int = 10) -> DataFrame:
    """Solved frames with most keypoints per match, earlier frames first on ties."""
    w = Window.partitionBy("match_id").orderBy(F.col("n_used").desc(), "frame_idx")
    return log.filter("solved").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def coverage_cells(log: DataFrame, img_w: float, img_h: float, cell: float = 1.0) -> DataFrame:
    """Directly solved frames that see each pitch cell: rows (match_id, row, col, frames).

    The image corners are projected and clipped to the pitch. A frame crosses each row of
    cells in one interval, so it sends two marks per row, +1 where the interval begins and
    -1 behind its end. Marks are summed per cell before the shuffle; a running sum along
    the row, at most ``PITCH_W / cell`` wide, gives the counts.
    """
    n_rows, n_cols = int(PITCH_H / cell), int(PITCH_W / cell)
    corners = [(0.0, 0.0), (img_w, 0.0), (img_w, img_h), (0.0, img_h)]
    points = [geo.img_to_world(F.col("h"), F.lit(x), F.lit(y)) for x, y in corners]
    clip = {f"x{i}": F.least(F.lit(PITCH_W), F.greatest(F.lit(0.0), p["x"])) for i, p in enumerate(points)}
    clip |= {f"y{i}": F.least(F.lit(PITCH_H), F.greatest(F.lit(0.0), p["y"])) for i, p in enumerate(points)}
    quads = log.filter("solved").select(*FRAME, *[e.alias(n) for n, e in clip.items()])
    rows = quads.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("row"))
    level = (F.col("row") + 0.5) * F.lit(cell)
    cuts = []
    for i in range(4):
        xa, ya, xb, yb = (F.col(f"{c}{k}") for k in (i, (i + 1) % 4) for c in "xy")
        crosses = (ya <= level) != (yb <= level)
        cuts.append(F.when(crosses, xa + (level - ya) * (xb - xa) / (yb - ya)))
    first = F.ceil(F.least(*cuts) / F.lit(cell) - 0.5).cast("int")
    end = (F.floor(F.greatest(*cuts) / F.lit(cell) - 0.5) + 1).cast("int")
    # a row the frame does not reach has no cuts; greatest and least would skip that null
    reached = rows.filter(F.coalesce(*cuts).isNotNull())
    spans = reached.select("match_id", "row", F.greatest(first, F.lit(0)).alias("a"), F.least(end, F.lit(n_cols)).alias("b")).filter("a < b")
    marks = F.explode(F.array(F.struct(F.col("a").alias("col"), F.lit(1).alias("d")), F.struct(F.col("b").alias("col"), F.lit(-1).alias("d"))))
    deltas = spans.select("match_id", "row", marks.alias("m")).groupBy("match_id", "row", "m.col").agg(F.sum("m.d").alias("d"))
    w = Window.partitionBy("match_id", "row").orderBy("col")
    runs = deltas.withColumns({"frames": F.sum("d").over(w), "stop": F.lead("col").over(w)}).filter("frames > 0")
    return runs.select("match_id", "row", F.explode(F.sequence("col", F.col("stop") - 1)).alias("col"), "frames")


def coverage(cells: DataFrame, cell: float = 1.0) -> DataFrame:
    """Share of pitch cells seen at least once, per match, in percent."""
    total = (PITCH_W / cell) * (PITCH_H / cell)
    return cells.groupBy("match_id").agg((F.count("*") * F.lit(100.0 / total)).alias("covered_pct"))
