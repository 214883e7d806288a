"""Stateless work on detection rows: one row per (match_id, frame_idx, det_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: class name per list of detections
ROUTES = {"players": "active_player", "referees": "referee", "goal_posts": "goal_post", "balls": "ball"}
# fixed value
MIN_CROP_AREA = 400
FRAME = ["match_id", "frame_idx"]


def name_classes(df: DataFrame, class_names: Column) -> DataFrame:
    """Class id to name; ``cls_<id>`` when the map has none."""
    fallback = F.concat(F.lit("cls_"), F.col("class_id").cast("string"))
    return df.withColumn("class_name", F.coalesce(F.try_element_at(class_names, F.col("class_id")), fallback))


def gate_confidence(df: DataFrame, player_conf: Column, ball_conf: Column) -> DataFrame:
    """Drop rows below the bar of their class."""
    bar = F.when(F.col("class_name") == "ball", ball_conf).otherwise(player_conf)
    return df.filter(F.col("confidence") >= bar)


def with_points(df: DataFrame) -> DataFrame:
    """Whole-pixel box, foot point and centre."""
    whole = df.withColumns({c: F.col(c).cast("long") for c in ("x1", "y1", "x2", "y2")})
    middle = F.floor((F.col("x1") + F.col("x2")) / 2).cast("long")
    return whole.withColumns(
        {
            "foot_x": middle,
            "foot_y": F.col("y2"),
            "cx": middle,
            "cy": F.floor((F.col("y1") + F.col("y2")) / 2).cast("long"),
        }
    )


def route(df: DataFrame) -> dict[str, DataFrame]:
    """Players, referees, goal posts and balls as filters over one scan."""
    return {name: df.filter(F.col("class_name") == cls) for name, cls in ROUTES.items()}


def timestamp_s(frame: Column, fps: Column) -> Column:
    return frame / F.greatest(fps, F.lit(1.0))


def frame_step(fps: Column, target_fps: float = 15.0) -> Column:
    return F.greatest(F.lit(1), F.bround(fps / F.lit(target_fps))).cast("long")


def stride(df: DataFrame, fps: Column, target_fps: float = 15.0, frame: str = "frame_idx") -> DataFrame:
    return df.filter(F.col(frame) % frame_step(fps, target_fps) == 0)


def sample_every(df: DataFrame, n: int, frame: str = "frame_idx") -> DataFrame:
    return df.filter(F.col(frame) % F.lit(n) == 0)


def resample_fps(df: DataFrame, src_fps: Column, target_fps: float, max_frames: int | None = None,
                 frame: str = "frame_idx") -> DataFrame:
    """First source frame of each target frame, renumbered from 0 as ``kept_idx``.

    Source frames are dense from 0, so whether a frame opens a new target frame, and
    which number it gets, follow from its own index: no window and no shuffle.
    """
    target = F.lit(float(target_fps))

    def slot(i: Column) -> Column:
        return F.floor(i * target / src_fps).cast("long")

    here = F.col(frame)
    opens = (here == 0) | (slot(here) > slot(here - 1))
    kept = df.filter(opens).withColumn("kept_idx", F.least(slot(here), here).cast("long"))
    return kept if max_frames is None else kept.filter(F.col("kept_idx") < max_frames)


def crop_gate(df: DataFrame, min_px: Column | int, blur: Column | float, inclusive: bool = False) -> DataFrame:
    """Crops large and sharp enough; ``inclusive`` also keeps sharpness equal to the bar."""
    sharp = F.col("sharpness") >= F.lit(blur) if inclusive else F.col("sharpness") > F.lit(blur)
    return df.filter((F.least("crop_w", "crop_h") >= F.lit(min_px)) & sharp)


def area_gate(df: DataFrame, least: int = MIN_CROP_AREA, channels: int = 3) -> DataFrame:
    """Crops that hold at least ``least`` values, a value per pixel and channel, each with the crop to take features from.

    That is the torso (torso_w, torso_h), or where the torso holds fewer values the whole crop (crop_w, crop_h); adds
    used_w, used_h and torso, which tells which it is.
    """
    torso = F.col("torso_w") * F.col("torso_h") * channels >= least
    large = df.filter(F.col("crop_w") * F.col("crop_h") * channels >= least)
    return large.withColumns({"torso": torso, "used_w": F.when(torso, F.col("torso_w")).otherwise(F.col("crop_w")), "used_h": F.when(torso, F.col("torso_h")).otherwise(F.col("crop_h"))})


def allow_classes(df: DataFrame, names: list[str]) -> DataFrame:
    return df.filter(F.col("class_name").isin(names))


def cap_duration(df: DataFrame, fps: Column, seconds: float, frame: str = "frame_idx") -> DataFrame:
    return df.filter(F.col(frame) < (fps * F.lit(seconds)).cast("long"))


def best_ball(balls: DataFrame) -> DataFrame:
    """Most confident ball per frame, the first one on ties."""
    rest = [c for c in balls.columns if c not in FRAME]
    best = F.max_by(F.struct(*rest), F.struct(F.col("confidence"), -F.col("ball_no"))).alias("b")
    return balls.groupBy(*FRAME).agg(best).select(*FRAME, "b.*")


def frame_windows(frame: Column, k: int = 16) -> Column:
    """Number of the fixed-size batch a processed frame falls into."""
    return F.floor(frame / F.lit(k)).cast("long")
