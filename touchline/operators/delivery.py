"""Outbox rows and the outcome of their delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions import counters as cnt
from touchline.operators.minutes import CLIP
from touchline.operators.scans import minute_bucket, number_rows

# fixed values
MAX_TRIES = 3
BACKOFF_BASE_S = 1.0
UNAUTHORISED = 401

PAYLOAD = T.StructType([T.StructField(cnt.wire_key(c), T.LongType()) for c in cnt.COUNTERS])


def outbox(bodies: DataFrame) -> DataFrame:
    return bodies.select(*CLIP, "payload", F.lit("pending").alias("status"), F.lit(0).alias("attempts"))


def read_payload(rows: DataFrame) -> DataFrame:
    return rows.select(*CLIP, F.from_json("payload", PAYLOAD).alias("body"))


def pending(rows: DataFrame) -> DataFrame:
    """Pending rows with their place in the order of their match."""
    waiting = rows.filter(F.col("status") == "pending")
    placed = number_rows(waiting, ["match_id"], minute_bucket(), ["half", "minute"], "position")
    return placed.withColumn("position", F.col("position") + 1)


def delivered(status: Column) -> Column:
    return status.between(200, 299)


def ledger(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Status and attempts of every pending row from the log of answers.

    A row is tried up to three times, stops at the first 2xx or at a 401, and never
    holds up the rows behind it. A row with fewer tries and no such answer stays pending.
    """
    tries = rows.filter(F.col("status") == "pending").join(answers, CLIP, "left")
    final = delivered(F.col("http_status")) | (F.col("http_status") == UNAUTHORISED)
    stop = F.min(F.when(final & (F.col("try_no") <= MAX_TRIES), F.struct("try_no", "http_status")))
    made = F.count_distinct(F.when(F.col("try_no") <= MAX_TRIES, F.col("try_no")))
    done = tries.groupBy(*CLIP).agg(stop.alias("stop"), F.max("attempts").alias("had"), made.alias("made"))
    sent = F.coalesce(delivered(F.col("stop.http_status")), F.lit(False))
    return done.select(
        *CLIP,
        F.when(sent, "sent").when(F.col("stop").isNotNull() | (F.col("made") >= MAX_TRIES), "failed").otherwise("pending").alias("status"),
        (F.col("had") + F.coalesce("stop.try_no", "made")).cast("int").alias("attempts"),
    )


def retry_wait_s(try_no: int) -> float:
    """Seconds to wait after a failed try, counted from 0."""
    return BACKOFF_BASE_S * 2**try_no
