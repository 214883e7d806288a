"""Table and CSV writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import scratch_path as scratch

# fixed values: columns of the match export
EXPORT_FIELDS = [
    "row_type",
    "match_id",
    "team_a_name",
    "team_b_name",
    "half",
    "period_label",
    "period_start_sec",
    "period_end_sec",
    "actual_duration_sec",
    "clip_count",
    "frames_team_a",
    "frames_team_b",
    "frames_loose",
    "frames_oof",
    "passes_completed_team_a",
    "passes_completed_team_b",
    "interceptions_team_a",
    "interceptions_team_b",
    "ball_lost_team_a",
    "ball_lost_team_b",
]
# fixed values: columns of the re-identification log
REID_FIELDS = [
    "frame",
    "event",
    "raw_id",
    "matched_stable_id",
    "candidate_stable_id",
    "similarity",
    "vlm_used",
    "vlm_verdict",
    "vlm_raw_text",
    "ocr_candidate_digits",
    "ocr_stored_digits",
]

__all__ = ["EXPORT_FIELDS", "REID_FIELDS", "append_events", "read_csv", "scratch", "write_csv", "write_table"]


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "append") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_events(events: DataFrame, path: str) -> DataFrame:
    """Append to the event log and read the log back."""
    write_table(events.withColumn("superseded", F.lit(0)), path)
    return events.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None, order: list[str] | None = None) -> None:
    """CSV with a header below ``path``; one folder per value of ``partition_by``.

    Rows are range-partitioned on (partition, order), so that a large match spreads
    over several files and small matches share a task.
    """
    if order:
        df = df.repartitionByRange(*(partition_by or []), *order).sortWithinPartitions(*(partition_by or []), *order)
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)
