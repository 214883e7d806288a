"""Stored tables: parquet folders or a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.counters import COUNTERS


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


# stored tables that a job writes or updates; columns the database fills in itself are left out
_COUNTS = ", ".join(f"{c} int" for c in COUNTERS)
STORED = {
    "events": "match_id string, half int, minute int, frame_idx bigint, kind string, from_team int, superseded int",
    "callback_outbox": "match_id string, half int, minute int, payload string, status string, attempts int",
    "post_processing": f"match_id string, team_a_name string, team_b_name string, {_COUNTS}, video_blob_path string",
}


def store(df: DataFrame, root: str, name: str) -> None:
    """Add rows to a stored table below ``root``."""
    columns = [f.split()[0] for f in STORED[name].split(", ")]
    typed = df.select(*[F.col(c).cast(t).alias(c) for c, t in (f.split() for f in STORED[name].split(", "))])
    typed.select(*columns).write.mode("append").parquet(f"{root}/{name}")


def scan_stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table with its declared columns; filters and columns reach the files."""
    return spark.read.schema(STORED[name]).parquet(f"{root}/{name}")


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, lower: int = 0,
              upper: int = 0, partitions: int = 1, **options: str) -> DataFrame:
    """A database table; filters and columns are pushed into the query.

    With ``partition_column`` (a number or a time) the table is read in parallel slices.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column:
        reader = reader.option("partitionColumn", partition_column).option("numPartitions", partitions)
        reader = reader.option("lowerBound", lower).option("upperBound", upper)
    return reader.load()
