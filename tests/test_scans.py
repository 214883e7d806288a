"""Split scans give what plain windows give."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import scans as sc

@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    # one group holds two thirds of all rows; gaps leave some buckets empty
    data = [("hot" if i % 3 else f"g{i % 4}", t, rnd.choice([None, 1, 2, 3, 5])) for i, t in enumerate(rnd.sample(range(900), 400))]
    return spark.createDataFrame(data, "g string, t bigint, v int").persist()


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_matches_plain_windows(rows, size):
    forward = Window.partitionBy("g").orderBy("t")
    upto = forward.rowsBetween(Window.unboundedPreceding, 0)
    before = forward.rowsBetween(Window.unboundedPreceding, -1)
    onward = forward.rowsBetween(0, Window.unboundedFollowing)
    plain = rows.select(
        "g", "t",
        F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("sum"),
        F.last("v", True).over(upto).alias("last"),
        F.last("v", True).over(before).alias("last_before"),
        F.max("v").over(before).alias("highest"),
        F.first("v", True).over(upto).alias("first"),
        F.lag("v").over(forward).alias("lag"),
        F.lead("v").over(forward).alias("lead"),
        F.first("v", True).over(onward).alias("next"),
    )
    v = F.col("v")
    out = {
        "sum": sc.running_sum(v), "last": sc.last_seen(v), "last_before": sc.last_before(v), "highest": sc.highest_before(v),
        "first": sc.first_seen(v), "lag": sc.previous(v), "lead": sc.following(v), "next": sc.next_seen(v),
    }
    split = sc.scan(rows, ["g"], sc.frame_bucket("t", size), ["t"], out).drop("v").select(*plain.columns)
    assert set(split.collect()) == set(plain.collect()) and split.count() == plain.count()


def test_row_numbers(rows):
    got = {(r.g, r.t): r.n for r in sc.number_rows(rows, ["g"], sc.frame_bucket("t", 16), ["t"], "n").collect()}
    for g in {k[0] for k in got}:
        times = sorted(t for k, t in got if k == g)
        assert [got[g, t] for t in times] == list(range(len(times)))


def test_large_side_is_shuffled_by_bucket(rows):
    plan = sc.scan(rows, ["g"], sc.frame_bucket("t", 16), ["t"], {"s": sc.running_sum(F.col("v"))})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in text.split("hashpartitioning(g", 1)[1][:40]


def test_events_share_buckets(spark):
    """A scan keeps a row per bucket, so there must be far fewer buckets than rows."""
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select(F.floor(F.col("user_id") / 12).alias("mno"), sc.time_bucket("ts").alias("bucket"))
    assert events.distinct().count() * 4 < events.count()
