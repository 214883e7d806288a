"""Keypoint logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYPOINT_LOG = (
    "match_id string, frame bigint, ts double, keypoints array<struct<idx:int,px:double,py:double,conf:double>>, "
    "n_used int, H_solved boolean, skip_reason string"
)


def read_keypoint_log(spark: SparkSession, path: str, arrays: bool = False) -> DataFrame:
    """Frames of a keypoint log: one JSON object per line, or one JSON array per file.

    An array file is read by a single task; long logs should be written as lines.
    """
    return spark.read.schema(KEYPOINT_LOG).option("multiLine", arrays).json(path)


def keypoints(log: DataFrame) -> DataFrame:
    """One row per keypoint."""
    return log.select("match_id", F.col("frame").alias("frame_idx"), F.explode("keypoints").alias("p")).select(
        "match_id", "frame_idx", "p.idx", "p.px", "p.py", "p.conf"
    )
