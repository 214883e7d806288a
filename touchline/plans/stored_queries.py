"""Scans of the stored event log, outbox and whole-match table (A3)."""

from pyspark.sql import functions as F

from touchline.functions import counters as cnt
from touchline.operators import minutes as mn
from touchline.plans.minute_queries import BODY, TOTALS
from touchline.plans.registry import query
from touchline.operators import delivery
from touchline.sources import tables, writers

KIND = "CASE k % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'interception' ELSE 'ball_lost' END"
LOGGED = f"SELECT match_id, half, minute, frame_idx, {KIND} AS kind, CAST(holder % 2 AS INT) AS from_team, CAST(CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS INT) AS superseded FROM fx_frames"


@query("a3_scan_events", f"SELECT match_id, kind, from_team, count(*) AS n FROM ({LOGGED}) e WHERE superseded = 0 AND (half < 1 OR (half = 1 AND minute <= 9)) GROUP BY ALL")
def a3_events(fx):
    """A3: stored events up to a minute that still count."""
    root = writers.scratch(fx.spark, "stored")
    tables.store(fx.sql(LOGGED), root, "events")
    log = tables.scan_stored(fx.spark, root, "events").filter(mn.upto(F.lit(1), F.lit(9)) & (F.col("superseded") == 0))
    return log.groupBy("match_id", "kind", "from_team").agg(F.count("*").alias("n"))


@query("a3_scan_outbox", f"WITH {TOTALS} SELECT match_id, half, minute, {BODY} AS payload, attempts FROM totals JOIN fx_outbox o USING (match_id, half, minute) WHERE o.status = 'pending'")
def a3_outbox(fx):
    """A3: stored deliveries that are pending."""
    root = writers.scratch(fx.spark, "stored")
    bodies = delivery.outbox(mn.payload(mn.cumulative(fx.minute_stats))).select("match_id", "half", "minute", "payload")
    tables.store(bodies.join(fx.outbox, ["match_id", "half", "minute"]), root, "callback_outbox")
    return tables.scan_stored(fx.spark, root, "callback_outbox").filter("status = 'pending'").drop("status")


@query("a3_scan_post_processing", "SELECT m.match_id, t.team_a_name, " + ", ".join(f"CAST(sum({c}) AS INT) AS {c}" for c in cnt.COUNTERS) + " FROM fx_minute_stats m JOIN fx_matches t USING (match_id) GROUP BY m.match_id, t.team_a_name")
def a3_post_processing(fx):
    """A3: stored whole-match rows."""
    root = writers.scratch(fx.spark, "stored")
    rows = mn.whole_match(fx.minute_stats).join(fx.matches.select("match_id", "team_a_name", "team_b_name"), "match_id")
    tables.store(rows.withColumn("video_blob_path", F.lit(None).cast("string")), root, "post_processing")
    return tables.scan_stored(fx.spark, root, "post_processing").select("match_id", "team_a_name", *cnt.COUNTERS)
