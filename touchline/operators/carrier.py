"""Who has the ball in each frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.joins import dealt
from touchline.operators.scans import FRAME_BUCKET, last_seen, scan

FRAME = ["match_id", "frame_idx"]


def zone_radius(y1: Column, y2: Column, ratio: Column | float, low: Column | int, high: Column | int) -> Column:
    height = F.greatest(F.lit(1), y2 - y1)
    return F.greatest(F.lit(low), F.least(F.lit(high), F.lit(ratio) * height))


def foot_distance(cx: Column, cy: Column) -> Column:
    foot = F.floor((F.col("x1") + F.col("x2")) / 2)
    return F.hypot(foot - cx, F.col("y2") - cy)


def in_zone(players: DataFrame, balls: DataFrame, ratio, low, high, how: str = "inner") -> DataFrame:
    """Ball and player pairs of a frame with the ball inside the player's foot zone."""
    able = players.filter(F.col("team_id").isin(0, 1) & F.col("track_id").isNotNull())
    pairs = balls.select(*FRAME, "cx", "cy").join(dealt(able), FRAME, how)
    dist = foot_distance(F.col("cx"), F.col("cy"))
    near = dist <= zone_radius(F.col("y1"), F.col("y2"), ratio, low, high)
    return pairs.withColumn("dist", dist).filter(near)


def raw_carrier(frames: DataFrame, players: DataFrame, balls: DataFrame, ratio, low, high) -> DataFrame:
    """State of every frame before smoothing.

    ``balls`` has at most one row per frame; a frame without one is ``oof``. Two
    teams in the zone, or nobody, is ``loose``; else the nearest player carries.
    All steps share one partitioning by (match, frame).
    """
    nearest = F.min_by(F.struct("track_id", "team_id"), F.struct("dist", "track_id"))
    inside = (
        in_zone(players, balls, ratio, low, high)
        .groupBy(*FRAME)
        .agg(nearest.alias("near"), (F.min("team_id") != F.max("team_id")).alias("contested"))
    )
    seen = balls.select(*FRAME, F.lit(True).alias("has_ball"))
    joined = frames.join(dealt(seen), FRAME, "left").join(dealt(inside), FRAME, "left")
    carried = F.col("near").isNotNull() & ~F.col("contested")
    kind = F.when(F.col("has_ball").isNull(), "oof").when(carried, "carrier").otherwise("loose")
    return joined.select(
        *frames.columns,
        kind.alias("kind"),
        F.when(kind == "carrier", F.col("near.track_id")).alias("track_id"),
        F.when(kind == "carrier", F.col("near.team_id")).alias("team_id"),
    )


def commit_carrier(raw: DataFrame, n: int | Column, size: int = FRAME_BUCKET, most: int | None = None) -> DataFrame:
    """Change state only after ``n`` frames in a row agree on (kind, track).

    ``n`` may be a column that is constant per match; ``most`` is then its upper bound.

    Frames are dense. The look-back is short, so each bucket gets a copy of the last
    ``n - 1`` frames of the bucket before it; only the held state crosses buckets. The look-back
    and the scan share one shuffle by (match, bucket).
    """
    back = (n if most is None else most) - 1
    home = F.floor(F.col("frame_idx") / F.lit(size)).cast("long")
    shared = F.pmod(F.col("frame_idx"), F.lit(size)) >= F.lit(size - back)
    copies = F.explode(F.when(shared, F.array(home, home + 1)).otherwise(F.array(home)))
    w = Window.partitionBy("match_id", "_bucket").orderBy("frame_idx")
    agrees = F.lit(True)
    for lag in range(1, back + 1):
        same = F.lag("kind", lag).over(w).eqNullSafe(F.col("kind")) & F.lag("track_id", lag).over(w).eqNullSafe(F.col("track_id"))
        agrees = agrees & (same | (F.lit(lag) >= n))
    state = F.struct("kind", "track_id", "team_id")
    marked = (
        raw.withColumn("_bucket", copies)
        .repartition("match_id", "_bucket")
        .withColumn("_stable", agrees)
        .filter(F.col("_bucket") == home)
        .withColumn("_stable", F.when(F.col("_stable"), state))
    )
    held = scan(marked, ["match_id"], None, ["frame_idx"], {"_held": last_seen(F.col("_stable"))})
    rest = [c for c in raw.columns if c not in ("kind", "track_id", "team_id")]
    return held.select(
        *rest,
        F.coalesce("_held.kind", F.lit("oof")).alias("kind"),
        F.col("_held.track_id").alias("track_id"),
        F.col("_held.team_id").alias("team_id"),
    )
