"""Uploads and clip messages: validation, numbering, ordering, match metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.colours import normalise_colour
from touchline.operators.rulesets import available_rulesets
from touchline.operators.scans import (
    FRAME_BUCKET,
    first_seen,
    frame_bucket,
    highest_before,
    last_before,
    last_seen,
    minute_bucket,
    number_rows,
    previous,
    running_sum,
    scan,
)

# fixed values
MAX_UPLOAD_BYTES = 2 * 1024**3
MAX_DEQUEUES = 3
ORDERING_RETRIES = 3
ORDERING_RETRY_S = 10
ALLOWED_TYPES = ["video/mp4", "application/octet-stream"]
NAMES = ["team_a_name", "team_b_name"]
COLOURS = ["team_a_colour", "team_b_colour", "team_a_gk_colour", "team_b_gk_colour"]
TEAM_FIELDS = NAMES + COLOURS
MESSAGE = (
    "match_id string, blob_path string, kind string, half int, minute int, clip_duration_seconds double, "
    "team_a_name string, team_b_name string, team_a_colour string, team_b_colour string, "
    "team_a_gk_colour string, team_b_gk_colour string, ordering_retries int"
)


def parse_messages(df: DataFrame, body: str = "body") -> DataFrame:
    """Message columns with their defaults; ``poison`` marks bodies that are no JSON."""
    parsed = F.from_json(F.col(body), MESSAGE + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rest = [c for c in df.columns if c != body]
    m = df.select(*rest, F.col(body), parsed.alias("m"))
    bad = F.col("m").isNull() | F.col("m._corrupt").isNotNull()
    defaults = {"kind": "clip", "half": 0, "minute": 0, "clip_duration_seconds": 60.0, "ordering_retries": 0}
    fields = [f.split()[0] for f in MESSAGE.split(", ")]

    def field(name: str) -> Column:
        value = F.col(f"m.{name}")
        if name in defaults:
            value = F.coalesce(value, F.lit(defaults[name]))
        return F.when(~bad, value).alias(name)

    return m.select(*rest, body, bad.alias("poison"), *[field(f) for f in fields])


def route_poison(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, poison): messages delivered too often go aside."""
    over = F.col("dequeue_count") > MAX_DEQUEUES
    return df.filter(~over), df.filter(over)


def blank(value: Column) -> Column:
    return F.coalesce(F.trim(value) == "", F.lit(True))


def validate_uploads(df: DataFrame) -> DataFrame:
    """Add ``status`` and ``reason``; 202 is accepted, the first failure counts."""
    empty = F.array(*[F.when(blank(F.col(f)), F.lit(f)) for f in TEAM_FIELDS])
    empty = F.concat_ws(", ", F.array_sort(F.array_compact(empty)))
    valid = available_rulesets()
    rules = [
        (~F.coalesce(F.col("content_type").isin(ALLOWED_TYPES), F.lit(True)), 415, F.concat(F.lit("unsupported content type: "), "content_type")),
        (F.col("size_bytes") > MAX_UPLOAD_BYTES, 413, F.lit("clip exceeds 2.0 GB cap")),
        (F.col("clip_duration_seconds") <= 0, 422, F.lit("clip_duration_seconds must be > 0")),
        (F.col("half") < 1, 422, F.lit("half must be >= 1")),
        (F.col("minute") < 1, 422, F.lit("minute must be >= 1")),
        (empty != "", 422, F.concat(F.lit("required field(s) empty: "), empty)),
        (~F.col("ruleset").isin(valid), 422, F.concat(F.lit("unknown ruleset "), "ruleset")),
    ]
    status, reason = F, F
    for test, code, text in rules:
        status, reason = status.when(test, F.lit(code)), reason.when(test, text)
    return df.withColumns({"status": status.otherwise(F.lit(202)), "reason": reason})


def complete_specs(matches: DataFrame, fields: list[str]) -> DataFrame:
    """Matches with every one of ``fields`` set; an empty text counts as missing."""
    present = F.lit(True)
    for f in fields:
        present = present & F.coalesce(F.col(f) != "", F.lit(False))
    return matches.filter(present)


def choose_matches(matches: DataFrame, args: list[str] | None = None, listed: str | None = None) -> DataFrame:
    """Matches to export: the given ids, else a comma list, else all by creation."""
    ids = args or [p.strip() for p in (listed or "").split(",") if p.strip()]
    return matches.filter(F.col("match_id").isin(ids)) if ids else matches


def claim_minutes(clips: DataFrame, size: int = FRAME_BUCKET) -> DataFrame:
    """Give the next number of its (match, half) to every clip without a minute."""
    open_ = clips.filter(F.col("minute").isNull() & F.col("half").isin(1, 2))
    fixed = clips.filter(F.col("minute").isNotNull() | ~F.col("half").isin(1, 2))
    numbered = number_rows(open_, ["match_id", "half"], frame_bucket("arrival", size), ["arrival"], "_n")
    numbered = numbered.withColumn("minute", (F.col("_n") + 1).cast("int")).drop("_n")
    return numbered.withColumn("claimed", F.lit(True)).unionByName(fixed.withColumn("claimed", F.lit(False)))


def is_expected(last_half: Column, last_minute: Column, half: Column, minute: Column) -> Column:
    """Next minute of the same half, or minute 1 of the next; a fresh match starts at (1, 1)."""
    fresh = (half == 1) & (minute == 1)
    after = ((half == last_half) & (minute == last_minute + 1)) | ((half == last_half + 1) & (minute == 1))
    return F.when(F.coalesce(last_minute, F.lit(0)) == 0, fresh).otherwise(after)


def ordering_guard(clips: DataFrame, bucket: Column, order: list[str]) -> DataFrame:
    """Mark clips that do not follow the clip before them."""
    last = {"last_half": previous(F.col("half")), "last_minute": previous(F.col("minute"))}
    seen = scan(clips, ["match_id"], bucket, order, last)
    ok = is_expected(F.col("last_half"), F.col("last_minute"), F.col("half"), F.col("minute"))
    return seen.withColumn("gap", ~ok)


def drop_processed(clips: DataFrame, done: DataFrame) -> DataFrame:
    """First arrival of each clip that has no stored minute yet."""
    key = ["match_id", "half", "minute"]
    rest = [c for c in clips.columns if c not in key]
    first = clips.groupBy(*key).agg(F.min_by(F.struct(*rest), "arrival").alias("_c")).select(*key, "_c.*")
    return first.join(done.select(*key), key, "left_anti")


def evolve_metadata(requests: DataFrame, size: int = FRAME_BUCKET) -> DataFrame:
    """Match metadata and fit generation after every request, in order of ``seq``.

    The first name given stays; the last colour given stays. A request that really
    changes a stored colour raises the generation once; a first fill-in does not. A
    ``reset`` request raises it always and also overwrites names.
    """
    reset = F.col("request") == "reset"
    # a match exists from its first clip request on; resets before it are ignored
    bucket = frame_bucket("seq", size)
    born = requests.filter(~reset).groupBy("match_id").agg(F.min("seq").alias("_born"))
    live = requests.join(born, "match_id").filter(F.col("seq") >= F.col("_born")).drop("_born")
    stored = {f"_old_{c}": last_before(F.col(c)) for c in COLOURS}
    now = {f"_now_{c}": last_seen(F.col(c)) for c in COLOURS}
    # names: a reset overwrites, a clip only fills an empty field
    given = {f"_set_{c}": last_seen(F.when(reset & F.col(c).isNotNull(), F.struct(F.col("seq"), F.col(c).alias("v")))) for c in NAMES}
    filled = {f"_first_{c}": first_seen(F.col(c)) for c in NAMES}
    step = scan(live, ["match_id"], bucket, ["seq"], {**stored, **now, **given, **filled}, keep_bucket=True)
    changed = F.lit(False)
    for c in COLOURS:
        old, new = F.col(f"_old_{c}"), F.col(c)
        differs = ~normalise_colour(old).eqNullSafe(normalise_colour(new))
        changed = changed | (old.isNotNull() & new.isNotNull() & differs)
    step = step.withColumn("_bump", F.when(reset | changed, 1).otherwise(0))
    step = scan(step, ["match_id"], None, ["seq"], {"_bumps": running_sum(F.col("_bump"))})
    return step.select(
        "match_id",
        "seq",
        *[F.coalesce(F.col(f"_set_{c}.v"), F.col(f"_first_{c}")).alias(c) for c in NAMES],
        *[F.col(f"_now_{c}").alias(c) for c in COLOURS],
        (1 + F.col("_bumps")).cast("int").alias("fit_generation"),
    )


def blank_fields(df: DataFrame) -> Column:
    """Sorted list of fields that are given but blank; such a reset is rejected."""
    present = F.array(*[F.when(F.trim(F.col(f)) == "", F.lit(f)) for f in TEAM_FIELDS if f in df.columns])
    return F.concat_ws(", ", F.array_sort(F.array_compact(present)))


def generation_resets(processed: DataFrame) -> DataFrame:
    """Add ``session_generation`` (held before the clip), ``reset`` and the clip before it.

    A session starts at generation 1 and moves up whenever a clip wants a higher one.
    """
    before = {
        "_had": highest_before(F.col("wanted_generation")),
        "upto_half": previous(F.col("half")),
        "upto_minute": previous(F.col("minute")),
    }
    seen = scan(processed, ["match_id"], minute_bucket(), ["half", "minute"], before)
    held = F.greatest(F.lit(1), "_had").cast("int")
    return seen.withColumn("session_generation", held).withColumn("reset", F.col("wanted_generation") > held).drop("_had")


def reset_points(processed: DataFrame) -> DataFrame:
    """Last clip before each reset: (match_id, upto_half, upto_minute)."""
    hit = F.col("reset") & F.col("upto_half").isNotNull()
    return generation_resets(processed).filter(hit).select("match_id", "upto_half", "upto_minute")


def read_fit_meta(matches: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Stored fit of every match; a missing or broken sidecar gives generation 1, no cluster."""
    meta = F.from_json("meta", "fit_generation int, team_a_cluster_id int")
    joined = matches.select("match_id").join(sidecars.select("match_id", meta.alias("m")), "match_id", "left")
    return joined.select(
        "match_id",
        F.coalesce("m.fit_generation", F.lit(1)).alias("fit_generation"),
        F.col("m.team_a_cluster_id").alias("team_a_cluster_id"),
    )


def split_video(videos: DataFrame, clip_s: float = 60.0) -> DataFrame:
    """Clips of at most ``clip_s`` seconds: (match_id, clip, start_s, length_s)."""
    count = F.ceil(F.col("duration_s") / F.lit(clip_s)).cast("int")
    clips = videos.filter(count > 0).select("match_id", "duration_s", F.explode(F.sequence(F.lit(0), count - 1)).alias("clip"))
    start = F.col("clip") * F.lit(clip_s)
    return clips.select("match_id", "clip", start.alias("start_s"), F.least(F.lit(clip_s), F.col("duration_s") - start).alias("length_s"))


def queue_metrics(manifest: DataFrame, now: Column) -> DataFrame:
    """Depths, lag and worker health from a manifest with ``state`` and ``heartbeat``."""
    depth = F.count_if(F.col("state") == "queued")
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.max("heartbeat").cast("timestamp"))
    return manifest.agg(
        depth.alias("queue_depth"),
        F.count_if(F.col("state") == "poison").alias("poison_depth"),
        (depth * 60).alias("seconds_behind_live"),
        F.coalesce(age < 300, F.lit(False)).alias("worker_alive"),
    )


def stage_timing(timings: DataFrame) -> DataFrame:
    """Milliseconds per processed frame of each stage of each clip: rows (clip, stage, frame, ms)."""
    clip = ["match_id", "half", "minute", "stage"]
    return timings.groupBy(*clip).agg(F.count("*").alias("frames"), (F.sum("ms") / F.count("*")).alias("ms_per_frame"))


def idle_sessions(clips: DataFrame, bucket: Column, idle_s: int = 1800) -> DataFrame:
    """Number the sessions of each match; a pause above ``idle_s`` ends one."""
    at = F.col("ts").cast("timestamp").cast("double")
    gaps = scan(clips, ["match_id"], bucket, ["ts"], {"_last": previous(at)}, keep_bucket=True)
    opens = F.when(F.col("_last").isNull() | (at - F.col("_last") > idle_s), 1).otherwise(0)
    opened = scan(gaps.withColumn("_opens", opens), ["match_id"], None, ["ts"], {"session": running_sum(F.col("_opens"))})
    return opened.drop("_last", "_opens")
