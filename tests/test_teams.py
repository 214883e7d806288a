"""Samples of crops: what a task sorts."""

from pyspark.sql import functions as F

from touchline.operators import teams


def test_sample_sorts_few_rows(spark):
    crops = spark.range(0, 40000, numPartitions=2).select(F.lit("m").alias("match_id"), F.col("id").alias("frame_idx"), (F.col("id") % 11).alias("track_id"),
                                                           F.when(F.col("id") % 3 > 0, F.col("id") % 3).cast("int").alias("cluster"))
    few = teams.smallest(crops, ["match_id", "cluster"], "frame_idx", 30)
    assert few.count() <= 40000 / 10000 * 2 * 3 * 30 and few.filter("frame_idx < 90").count() == 90
    got = teams.sample_per_cluster(crops)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    rows = [(r.cluster, r.frame_idx) for r in got.collect()]
    key = F.md5(F.concat_ws(":", F.lit("0"), "match_id", F.col("frame_idx").cast("string"), F.col("track_id").cast("string")))
    for cluster in (None, 1, 2):
        mine = crops.filter(F.col("cluster").eqNullSafe(cluster)).orderBy(key).limit(30)
        assert sorted(f for c, f in rows if c == cluster) == sorted(r.frame_idx for r in mine.collect())
