"""Ball smoothing and box plausibility, as folds along the frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.folds import fold
from touchline.operators.joins import dealt
from touchline.operators.scans import FRAME_BUCKET, frame_bucket, last_seen, scan

# fixed values: noise of position, velocity and measurement, and the variance at the first sight
POSITION_NOISE, VELOCITY_NOISE, MEASURE_NOISE, SEED_VARIANCE = 4.0, 25.0, 9.0, 100.0
# fixed values
DETECTED, COASTING, LOST = "detected", "coasting", "lost"
MAX_AREA_SHARE, MAX_AREA_GROWTH = 0.20, 3.0

BALL_START = (False, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)
BALL_OUTPUT = "ball_state string, bx bigint, by bigint, ball_conf double"


def ball_step(state: tuple, _frame: int, row: tuple) -> tuple[tuple, tuple]:
    """One frame of a constant-velocity filter.

    Both axes share one covariance (p, c, v), since their noise is equal. State: seen,
    x, vx, y, vy, p, c, v, frames without a ball. Row: cx, cy, confidence, coast, sigma.
    """
    seen, x, vx, y, vy, p, c, v, missing = state
    mx, my, conf, coast, sigma = row
    if not seen:
        if mx is None:
            return state, (LOST, None, None, None)
        fresh = (True, float(mx), 0.0, float(my), 0.0, SEED_VARIANCE, 0.0, SEED_VARIANCE, 0)
        return fresh, (DETECTED, int(mx), int(my), conf)

    x, y = x + vx, y + vy
    p, c, v = p + 2.0 * c + v + POSITION_NOISE, c + v, v + VELOCITY_NOISE
    if mx is not None:
        dx, dy, spread = mx - x, my - y, p + MEASURE_NOISE
        if (dx * dx + dy * dy) / spread <= sigma * sigma:
            g, h = p / spread, c / spread
            x, vx, y, vy = x + g * dx, vx + h * dx, y + g * dy, vy + h * dy
            p, c, v = (1.0 - g) * p, (1.0 - g) * c, v - h * c
            return (True, x, vx, y, vy, p, c, v, 0), (DETECTED, int(x), int(y), conf)
    # a rejected ball counts as missing; the prediction carries on
    missing += 1
    result = (COASTING, int(x), int(y), 0.0) if missing <= coast else (LOST, None, None, None)
    return (True, x, vx, y, vy, p, c, v, missing), result


def smooth_ball(frames: DataFrame, size: int = FRAME_BUCKET, warmup: int = 256) -> DataFrame:
    """Smoothed ball of every frame.

    ``frames``: match_id, frame_idx, cx, cy, confidence (null without a ball), coast, sigma.
    """
    inputs = ["cx", "cy", "confidence", "coast", "sigma"]
    return fold(frames, ["match_id"], "frame_idx", inputs, ball_step, BALL_START, BALL_OUTPUT, size=size, warmup=warmup)


def held_boxes(smoothed: DataFrame, balls: DataFrame, size: int = FRAME_BUCKET) -> DataFrame:
    """``smoothed`` with the ball's box: its own where it was accepted, the last accepted one while it coasts, none when lost.

    ``balls``: one row per frame at most, with x1, y1, x2, y2.
    """
    sides = ["x1", "y1", "x2", "y2"]
    box = F.when(F.col("ball_state") == DETECTED, F.struct(*sides))
    joined = smoothed.join(dealt(balls.select("match_id", "frame_idx", *sides)), ["match_id", "frame_idx"], "left")
    seen = scan(joined, ["match_id"], frame_bucket(size=size), ["frame_idx"], {"_held": last_seen(box)})
    return seen.select(*smoothed.columns, *[F.when(F.col("ball_state") != LOST, F.col(f"_held.{c}")).alias(c) for c in sides])


def area_step(state: tuple, _frame: int, row: tuple) -> tuple[tuple, tuple]:
    (last,), (area, limit) = state, row
    ok = area <= limit and not (last > 0 and area > MAX_AREA_GROWTH * last)
    return ((float(area),) if ok else state), (ok,)


def plausible_boxes(boxes: DataFrame, frame_area: Column, size: int = FRAME_BUCKET) -> DataFrame:
    """Add ``accepted``: not too large a part of the frame, nor a sudden growth of its track."""
    area = F.greatest(F.lit(0), F.col("x2") - F.col("x1")) * F.greatest(F.lit(0), F.col("y2") - F.col("y1"))
    rows = boxes.select("match_id", "track_id", "frame_idx", area.cast("double").alias("area"),
                        (frame_area * F.lit(MAX_AREA_SHARE)).alias("limit"))
    return fold(rows, ["match_id", "track_id"], "frame_idx", ["area", "limit"], area_step, (0.0,), "accepted boolean", size=size)
