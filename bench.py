"""Time the headline queries and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from touchline.plans.catalogue import QUERIES  # noqa: E402
from touchline.session import local_session  # noqa: E402

HEADLINE = [
    "e7_cumulative_payload",
    "b3_box_points",
    "f1_best_ball",
    "f2_nearest_player",
    "e1_carrier_hysteresis",
    "i1_ball_filter",
    "i2_pass_events",
    "i5_clip_counters",
    "i17_minutes_batch",
    "d1_label_counts",
    "g1_export_rows",
    "e9_metadata_evolution",
    "i15_delivery_ledger",
    "c2_goalkeepers",
    "d21_colour_histogram",
    "d22_mean_colour",
    "d19_silhouette",
    "e5_filled_homographies",
    "d26_coverage_cells",
    "e4_track_gaps",
    "d13_running_team",
    "c9_duplicate_pairs",
    "c8_reid_candidates",
    "f7_gallery",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, name="bench")
    spark.sparkContext.setLogLevel("OFF")
    # first use of the session is not part of any query; the frames table that most queries read is
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    start = time.perf_counter()
    QUERIES["b7_sample_every"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times["frames_table"] = round(time.perf_counter() - start, 3)
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
