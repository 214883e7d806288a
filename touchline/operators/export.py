"""Match export: minutes, five-minute blocks and match totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import counters as cnt
from touchline.operators.scans import last_seen, next_seen, number_rows, running_sum, scan
from touchline.session import durable
from touchline.sources.writers import EXPORT_FIELDS, write_csv

# fixed values, in seconds
BLOCK_MIN_S = 280.0

KEY = ["match_id", "half"]


def seconds(col: str = "clip_duration_seconds"):
    return F.coalesce(F.col(col), F.lit(0)).cast("double")


def team_names(matches: DataFrame) -> DataFrame:
    """Names for display; an empty one becomes Team 0 or Team 1."""
    named = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)).alias(c) for c, d in (("team_a_name", "Team 0"), ("team_b_name", "Team 1"))]
    return matches.select("match_id", *named)


def minute_periods(rows: DataFrame, size: int = 1024) -> DataFrame:
    """Minute rows with running seconds inside their half."""
    bucket = F.floor(F.col("minute") / F.lit(size)).cast("long")
    timed = rows.withColumn("actual_duration_sec", seconds())
    timed = scan(timed, KEY, bucket, ["minute"], {"period_end_sec": running_sum(F.col("actual_duration_sec"))})
    return timed.select(
        F.lit("minute").alias("row_type"),
        *KEY,
        cnt.minute_label(F.col("half"), F.col("minute")).alias("period_label"),
        (F.col("period_end_sec") - F.col("actual_duration_sec")).alias("period_start_sec"),
        "period_end_sec",
        "actual_duration_sec",
        F.lit(1).cast("long").alias("clip_count"),
        *[F.col(c).cast("long").alias(c) for c in cnt.COUNTERS],
        F.col("minute").cast("long").alias("seq"),
    )


def _jumps(rows: DataFrame, target: int, size: int) -> DataFrame:
    """For every minute row the place of the row that would open the next block if this one opened a block, null at the end.

    ``rows``: ``KEY``, at, before and end, the running seconds in millionths before and after the row. A block closes with the first
    row whose end reaches ``target`` beyond the block's own start, so ends and looked-for ends are sorted together and each
    of the latter takes the next end from there on.
    """
    ends = rows.select(*KEY, F.col("end").alias("value"), F.lit(1).alias("is_end"), "at")
    wanted = rows.select(*KEY, (F.col("before") + target).alias("value"), F.lit(0).alias("is_end"), "at")
    bucket = F.floor(F.col("value") / (F.lit(60_000_000 * size))).cast("long")
    closing = scan(wanted.unionByName(ends), KEY, bucket, ["value", "is_end", "at"], {"closes": next_seen(F.when(F.col("is_end") == 1, F.col("at")))})
    return closing.where("is_end = 0 AND closes IS NOT NULL").select(*KEY, "at", (F.col("closes") + 1).alias("to"))


def assign_blocks(rows: DataFrame, target_s: float = BLOCK_MIN_S, size: int = 4096) -> DataFrame:
    """Block of every minute row: a block closes once it holds ``target_s`` seconds.

    Blocks over the upper bound need no rule of their own, since a block that
    reached the lower bound is closed already. Which rows open a block is found by doubling jumps from opening to opening, so the
    rounds grow with the logarithm of the number of blocks in a half. Durations count in millionths of a second.
    """
    minute = F.floor(F.col("minute") / F.lit(size)).cast("long")
    length = F.round(F.coalesce(F.col("clip_duration_seconds").cast("decimal(18,6)"), F.lit(0)) * 1_000_000).cast("long")
    timed = rows.select(*KEY, F.col("minute").cast("long").alias("minute"), length.alias("length"))
    counted = {"end": running_sum(F.col("length")), "at": running_sum(F.lit(1).cast("long"))}
    timed = scan(timed, KEY, minute, ["minute"], counted)
    timed = durable(timed.select(*KEY, "minute", "end", (F.col("end") - F.col("length")).alias("before"), (F.col("at") - 1).alias("at")), "minutes")
    levels = [durable(_jumps(timed, round(target_s * 1_000_000), size), "jumps")]
    while True:
        last = levels[-1]
        twice = last.join(last.select(*KEY, F.col("at").alias("to"), F.col("to").alias("_to")), [*KEY, "to"])
        twice = durable(twice.select(*KEY, "at", F.col("_to").alias("to")), "jumps")
        if twice.isEmpty():
            break
        levels.append(twice)
    opens = timed.where("at = 0").select(*KEY, "at")
    for jumps in reversed(levels):
        opens = opens.unionByName(opens.join(jumps, [*KEY, "at"]).select(*KEY, F.col("to").alias("at")))
    opened = timed.join(opens.withColumn("_opens", F.lit(1)), [*KEY, "at"], "left")
    marks = {"block": running_sum(F.col("_opens")), "_start": last_seen(F.when(F.col("_opens") == 1, F.col("before")))}
    marked = scan(opened, KEY, minute, ["minute"], marks)
    return marked.select(*KEY, "minute", F.col("block").cast("int").alias("block"), (F.col("_start") / 1_000_000).alias("block_start"))


def block_periods(rows: DataFrame) -> DataFrame:
    """Sums per block; the last block of a half may be short."""
    placed = rows.join(assign_blocks(rows), [*KEY, "minute"])
    total = F.sum(seconds())
    return (
        placed.groupBy(*KEY, "block", "block_start")
        .agg(total.alias("actual_duration_sec"), F.count("*").alias("clip_count"), *[F.sum(c).cast("long").alias(c) for c in cnt.COUNTERS])
        .select(
            F.lit("block_5min").alias("row_type"),
            *KEY,
            cnt.block_label(F.col("half"), F.col("block")).alias("period_label"),
            F.col("block_start").alias("period_start_sec"),
            (F.col("block_start") + F.col("actual_duration_sec")).alias("period_end_sec"),
            "actual_duration_sec",
            "clip_count",
            *cnt.COUNTERS,
            F.col("block").cast("long").alias("seq"),
        )
    )


def match_totals(rows: DataFrame) -> DataFrame:
    """One row per match over all its minutes."""
    sums = [F.sum(c).cast("long").alias(c) for c in cnt.COUNTERS]
    total = rows.groupBy("match_id").agg(F.sum(seconds()).alias("actual_duration_sec"), F.count("*").alias("clip_count"), *sums)
    return total.select(
        F.lit("match_total").alias("row_type"),
        "match_id",
        F.lit(None).cast("int").alias("half"),
        F.lit("MATCH_TOTAL").alias("period_label"),
        F.lit(0.0).alias("period_start_sec"),
        F.col("actual_duration_sec").alias("period_end_sec"),
        "actual_duration_sec",
        "clip_count",
        *cnt.COUNTERS,
        F.lit(0).cast("long").alias("seq"),
    )


def export_rows(minute_stats: DataFrame, matches: DataFrame) -> DataFrame:
    """All export rows with their sort key: half, then minutes before blocks, total last.

    Superseded minutes are exported too. Minute rows are computed once, with their block, and one pass over grouping sets
    makes minutes, blocks and totals of them.
    """
    minute = F.floor(F.col("minute") / F.lit(1024)).cast("long")
    source = durable(minute_stats.select(*KEY, F.col("minute").cast("long").alias("minute"), "clip_duration_seconds", *cnt.COUNTERS), "minutes")
    timed = scan(source.withColumn("_s", seconds()), KEY, minute, ["minute"], {"_end": running_sum(F.col("_s"))})
    placed = timed.join(assign_blocks(source), [*KEY, "minute"])
    sets = [[*KEY, "minute"], [*KEY, "block"], ["match_id"]]
    sums = [F.sum(c).cast("long").alias(c) for c in cnt.COUNTERS]
    rank = F.when(F.grouping("minute") == 0, 0).when(F.grouping("block") == 0, 1).otherwise(2)
    start = F.when(rank == 0, F.min(F.col("_end") - F.col("_s"))).when(rank == 1, F.min("block_start")).otherwise(0.0)
    rows = placed.groupingSets(sets, *KEY, "minute", "block").agg(
        rank.cast("long").alias("sort_rank"), start.alias("period_start_sec"), F.max("_end").alias("_last"), F.sum("_s").alias("actual_duration_sec"), F.count("*").alias("clip_count"), *sums
    )
    kind = F.col("sort_rank")
    label = F.when(kind == 0, cnt.minute_label(F.col("half"), F.col("minute"))).when(kind == 1, cnt.block_label(F.col("half"), F.col("block"))).otherwise("MATCH_TOTAL")
    end = F.when(kind == 0, F.col("_last")).otherwise(F.col("period_start_sec") + F.col("actual_duration_sec"))
    times = {"period_start_sec": F.round("period_start_sec", 2), "period_end_sec": F.round(end, 2), "actual_duration_sec": F.round("actual_duration_sec", 2)}
    return rows.join(team_names(matches), "match_id").select(
        F.when(kind == 0, "minute").when(kind == 1, "block_5min").otherwise("match_total").alias("row_type"),
        *KEY,
        label.alias("period_label"),
        *[c.alias(n) for n, c in times.items()],
        "clip_count",
        *cnt.COUNTERS,
        F.when(kind == 0, F.col("minute")).when(kind == 1, F.col("block").cast("long")).otherwise(0).alias("seq"),
        "team_a_name",
        "team_b_name",
        F.coalesce("half", F.lit(1 << 30)).cast("long").alias("sort_half"),
        "sort_rank",
    )


def with_position(rows: DataFrame, size: int = 1024) -> DataFrame:
    """Place of every row inside the file of its match, from 1."""
    bucket = (F.col("sort_half") * 4 + F.col("sort_rank")) * F.lit(1 << 20) + F.floor(F.col("seq") / F.lit(size))
    placed = number_rows(rows, ["match_id"], bucket.cast("long"), ["sort_half", "sort_rank", "seq"], "position")
    return placed.withColumn("position", F.col("position") + 1)


def write_export(rows: DataFrame, path: str) -> None:
    """CSV per match, in folders named after the safe form of the match id."""
    keyed = rows.withColumn("file", cnt.safe_filename(F.col("match_id")))
    sort = ["sort_half", "sort_rank", "seq"]
    fields = [F.coalesce(F.col("half").cast("string"), F.lit("")).alias("half") if f == "half" else F.col(f) for f in EXPORT_FIELDS]
    ordered = keyed.repartitionByRange("file", *sort).sortWithinPartitions("file", *sort)
    write_csv(ordered.select("file", *fields), path, ["file"])
