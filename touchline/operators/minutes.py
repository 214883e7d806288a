"""Minute counters: building, correcting, orienting, summing, delivering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import counters as cnt
from touchline.operators.joins import dealt
from touchline.operators.scans import minute_bucket, previous, running_sum, scan

CLIP = ["match_id", "half", "minute"]


def upto(half: Column, minute: Column) -> Column:
    """Rows at or before (half, minute), in a form scans can push down."""
    return (F.col("half") < half) | ((F.col("half") == half) & (F.col("minute") <= minute))


def label_counts(labels: DataFrame) -> DataFrame:
    """Frames per label and minute; an unknown label counts as oof."""
    known = {"frames_team_a": "team_a", "frames_team_b": "team_b", "frames_loose": "loose"}
    n = {c: F.count_if(F.col("label") == v).cast("int") for c, v in known.items()}
    n["frames_oof"] = F.count_if(~F.coalesce(F.col("label"), F.lit("")).isin(*known.values())).cast("int")
    return labels.groupBy(*CLIP).agg(*[e.alias(c) for c, e in n.items()])


def event_counts(events: DataFrame) -> DataFrame:
    """Events per kind and passing team; other teams are not counted."""
    names = {"completed": "passes_completed", "interception": "interceptions", "ball_lost": "ball_lost"}
    out = []
    for kind, name in names.items():
        for team, suffix in ((0, "team_a"), (1, "team_b")):
            hit = (F.col("kind") == kind) & (F.col("from_team") == team)
            out.append(F.count_if(hit).cast("int").alias(f"{name}_{suffix}"))
    return events.groupBy(*CLIP).agg(*out)


def cumulative_read(rows: DataFrame, half: Column, minute: Column) -> DataFrame:
    """Totals per match up to one (half, minute), superseded rows left out."""
    kept = rows.filter((F.col("superseded") == 0) & upto(half, minute))
    return kept.groupBy("match_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in cnt.COUNTERS])


def cumulative(rows: DataFrame) -> DataFrame:
    """Totals up to every minute of every match, superseded rows left out."""
    counted = {c: running_sum(F.when(F.col("superseded") == 0, F.col(c)).cast("long")) for c in cnt.COUNTERS}
    base = rows.select(*CLIP, "revision", "superseded", *cnt.COUNTERS)
    total = scan(base, ["match_id"], minute_bucket(), ["half", "minute"], {f"cum_{c}": s for c, s in counted.items()})
    return total.select(*CLIP, "revision", *[F.col(f"cum_{c}").alias(c) for c in cnt.COUNTERS])


def payload(totals: DataFrame) -> DataFrame:
    """Totals renamed to the keys of the delivered body, and the body as JSON."""
    keys = [F.col(c).cast("long").alias(cnt.wire_key(c)) for c in cnt.COUNTERS]
    return totals.select(*CLIP, *keys, F.to_json(F.struct(*keys)).alias("payload"))


def possession(rows: DataFrame) -> DataFrame:
    """Possession shares: over team frames only, over team and loose frames, over all."""
    a, b, loose, oof = (F.col(c) for c in cnt.COUNTERS[:4])
    every = F.greatest(F.lit(1), a + b + loose + oof)
    return rows.withColumns(
        {
            "possession_a": cnt.share(a, a + b),
            "possession_b": cnt.share(b, a + b),
            "possession_with_loose_a": cnt.share(a, a + b + loose),
            "possession_with_loose_b": cnt.share(b, a + b + loose),
            "loose_share": F.lit(100.0) * loose / every,
            "oof_share": F.lit(100.0) * oof / every,
        }
    )


def pass_rates(rows: DataFrame) -> DataFrame:
    """Both pass accuracies and the pass density of each team."""
    out = {}
    for team in ("team_a", "team_b"):
        ok, cut, lost = (F.col(f"{c}_{team}") for c in ("passes_completed", "interceptions", "ball_lost"))
        out[f"accuracy_{team}"] = cnt.share(ok, ok + cut + lost)
        out[f"overlay_accuracy_{team}"] = F.lit(100.0) * ok / F.greatest(F.lit(1), ok + cut)
        seconds = F.coalesce(F.col("clip_duration_seconds").cast("double"), F.lit(0.0))
        out[f"density_{team}"] = cnt.share(ok, seconds, 60.0)
    return rows.withColumns(out)


def apply_corrections(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """Correct earlier minutes; a corrected row gains a revision, a missing one nothing.

    At most one correction per minute row: (match_id, half, minute, kind, team_id, frames).
    """
    due = corrections.filter((F.col("frames") > 0) & F.col("kind").isin("flip_to", "drop"))
    joined = rows.join(dealt(due.select(*CLIP, "kind", "team_id", F.col("frames").alias("_n"))), CLIP, "left")
    new = cnt.adjust(F.col("kind"), F.col("team_id"), F.col("_n"), *[F.col(f"frames_{x}") for x in ("team_a", "team_b", "oof")])
    return (
        joined.withColumn("_new", new)
        .withColumns(
            {
                "frames_team_a": F.col("_new.a").cast("int"),
                "frames_team_b": F.col("_new.b").cast("int"),
                "frames_oof": F.col("_new.oof").cast("int"),
                "revision": (F.col("revision") + F.when(F.col("_n").isNotNull(), 1).otherwise(0)).cast("int"),
            }
        )
        .select(*rows.columns)
    )


def orient_rows(rows: DataFrame, cluster: str = "team_a_cluster_id") -> DataFrame:
    """Swap the sides where team a is cluster 1; null means no swap."""
    swap = F.coalesce(F.col(cluster) != 0, F.lit(False))
    out = {}
    for c in cnt.COUNTERS:
        other = c[:-1] + {"a": "b", "b": "a"}[c[-1]] if "_team_" in c else c
        out[c] = F.when(swap, F.col(other)).otherwise(F.col(c))
    return rows.withColumns(out)


def orient_teams(rows: DataFrame, columns: list[str], cluster: str) -> DataFrame:
    """Flip team ids of events or corrections under the given orientation."""
    swap = F.coalesce(F.col(cluster) != 0, F.lit(False))
    return rows.withColumns({c: F.when(swap, cnt.flip_team(F.col(c))).otherwise(F.col(c)) for c in columns})


def with_previous_orientation(rows: DataFrame, cluster: str = "team_a_cluster_id") -> DataFrame:
    """Orientation the row before was written under, and which row that was."""
    return scan(
        rows,
        ["match_id"],
        minute_bucket(),
        ["half", "minute"],
        {
            "previous_cluster_id": previous(F.col(cluster)),
            "previous_half": previous(F.col("half")),
            "previous_minute": previous(F.col("minute")),
        },
    )


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Minute rows after a write: new counters win, revision and superseded stay.

    ``new`` carries ``write_seq``; the last write of a key wins. An unseen key starts
    at revision 0.
    """
    data = [c for c in old.columns if c not in (*CLIP, "revision", "superseded")]
    latest = new.groupBy(*CLIP).agg(F.max_by(F.struct(*data), "write_seq").alias("_new"))
    both = old.join(latest, CLIP, "full")
    return both.select(
        *CLIP,
        *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in data],
        F.coalesce("revision", F.lit(0)).alias("revision"),
        F.coalesce("superseded", F.lit(0)).alias("superseded"),
    ).select(*old.columns)


def supersede(rows: DataFrame, resets: DataFrame) -> DataFrame:
    """Flag rows at or before each match's reset point (match_id, upto_half, upto_minute)."""
    last = resets.groupBy("match_id").agg(F.max(F.struct("upto_half", "upto_minute")).alias("_reset"))
    hit = upto(F.col("_reset.upto_half"), F.col("_reset.upto_minute"))
    joined = rows.join(last, "match_id", "left")
    flag = F.when(F.coalesce(hit, F.lit(False)), F.lit(1)).otherwise(F.col("superseded"))
    return joined.withColumn("superseded", flag.cast("int")).select(*rows.columns)


def superseded_count(tables: list[DataFrame], resets: DataFrame) -> DataFrame:
    """Rows per match that a reset would newly flag, over several tables."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    hit = (F.col("superseded") == 0) & upto(F.col("upto_half"), F.col("upto_minute"))
    return rows.join(resets, "match_id").filter(hit).groupBy("match_id").agg(F.count("*").alias("n"))


def match_progress(writes: DataFrame) -> DataFrame:
    """Last written (half, minute) per match, in order of ``write_seq``."""
    last = writes.groupBy("match_id").agg(F.max_by(F.struct("half", "minute"), "write_seq").alias("last"))
    return last.select("match_id", F.col("last.half").alias("last_half"), F.col("last.minute").alias("last_minute"))


def pass_summary(events: DataFrame) -> DataFrame:
    """Successful and inaccurate passes per passing team; lost balls do not count."""
    return events.filter(F.col("team_id").isin(0, 1)).groupBy("match_id", F.col("team_id").cast("int").alias("team_id")).agg(
        F.count_if(F.col("kind") == "completed").alias("successful"),
        F.count_if(F.col("kind") == "interception").alias("inaccurate"),
    )


def whole_match(rows: DataFrame) -> DataFrame:
    """One row per match, stored as half 1, minute 1, without a duration."""
    sums = [F.sum(c).cast("long").alias(c) for c in cnt.COUNTERS]
    return rows.groupBy("match_id").agg(*sums).select(
        "match_id", F.lit(1).alias("half"), F.lit(1).alias("minute"), F.lit(0.0).alias("clip_duration_seconds"), *cnt.COUNTERS
    )


def latest_post_processing(writes: DataFrame, details: list[str]) -> DataFrame:
    """Last whole-match write per match; the path falls back to the row's own."""
    path = F.coalesce(F.nullif(F.col("video_blob_path"), F.lit("")), F.col("clip_blob_path"))
    kept = F.struct(*details, path.alias("video_blob_path"), *cnt.COUNTERS)
    return writes.groupBy("match_id").agg(F.max_by(kept, "write_seq").alias("w")).select("match_id", "w.*")
