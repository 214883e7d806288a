"""Ordered scans (running sums, carried values, lag and lead) over split groups.

A plain window partitioned by match puts a whole match into one task. Here
a group is cut into buckets that follow the order of its rows. Every bucket is
scanned on its own; one summary row per bucket is then scanned per group and
joined back. The large side is shuffled once, by (keys, bucket).

``bucket`` must be a column that never decreases in the order of the rows, and
``order`` must be unique inside a group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.joins import dealt

# rows of one bucket; about eighteen minutes of play at 15 frames per second
FRAME_BUCKET = 16384


def frame_bucket(col: str = "frame_idx", size: int = FRAME_BUCKET) -> Column:
    return F.floor(F.col(col) / F.lit(size)).cast("long")


def minute_bucket(size: int = 1024) -> Column:
    """Bucket for rows ordered by (half, minute)."""
    return F.col("half").cast("long") * F.lit(1 << 40) + F.floor(F.col("minute") / F.lit(size)).cast("long")


def time_bucket(col: str = "ts", seconds: int = 6 * 3600) -> Column:
    """Bucket for rows ordered by a time: short enough to split the days of a busy match, long enough to hold many rows of one,
    since a scan keeps a row per bucket beside the table."""
    return F.floor(F.unix_timestamp(F.col(col).cast("timestamp")) / F.lit(seconds)).cast("long")


@dataclass(frozen=True)
class Scan:
    kind: str
    col: Column


def running_sum(col: Column) -> Scan:
    """Sum of all rows up to this one, nulls skipped; 0 before any value."""
    return Scan("sum", col)


def last_seen(col: Column) -> Scan:
    """Last non-null value up to and including this row."""
    return Scan("last", col)


def last_before(col: Column) -> Scan:
    """Last non-null value strictly before this row."""
    return Scan("last_before", col)


def highest_before(col: Column) -> Scan:
    """Largest value strictly before this row."""
    return Scan("highest_before", col)


def first_seen(col: Column) -> Scan:
    """First non-null value of the group, once it has been reached."""
    return Scan("first", col)


def next_seen(col: Column) -> Scan:
    """First non-null value from this row on."""
    return Scan("next", col)


def previous(col: Column) -> Scan:
    """Value of the row before, null values included."""
    return Scan("previous", col)


def following(col: Column) -> Scan:
    """Value of the row after, null values included."""
    return Scan("following", col)


def scan(
    df: DataFrame, keys: list[str], bucket: Column | None, order: list[str], out: dict[str, Scan], keep_bucket: bool = False
) -> DataFrame:
    """Add one column per entry of ``out``.

    With ``bucket`` None, ``df`` has a column ``_bucket`` and is dealt by (keys, ``_bucket``) already, as after a
    window over them or a scan with ``keep_bucket``; no further shuffle of the large side follows.
    """
    group = [*keys, "_bucket"]
    inner = Window.partitionBy(*group).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    from_here = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*keys).orderBy("_bucket")
    past = across.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*order)

    held, local, digest, carry, final = {}, {}, [], {}, {}
    for name, s in out.items():
        v, l, d, c = (f"_{p}_{name}" for p in ("v", "l", "d", "c"))
        value = F.struct(s.col.alias("v")) if s.kind in ("previous", "following") else s.col
        held[v] = value
        at = F.when(F.col(v).isNotNull(), position)
        backwards = s.kind in ("next", "following")
        if s.kind == "sum":
            local[l] = F.sum(v).over(upto)
            digest.append(F.sum(v).alias(d))
            carry[c] = F.sum(d).over(past)
            zero = F.lit(0)
            final[name] = F.coalesce(F.col(c), zero) + F.coalesce(F.col(l), zero)
            continue
        if s.kind == "highest_before":
            local[l] = F.max(v).over(before)
            digest.append(F.max(v).alias(d))
            carry[c] = F.max(d).over(past)
            final[name] = F.greatest(F.col(c), F.col(l))
            continue
        if s.kind == "first":
            local[l] = F.first(v, ignorenulls=True).over(upto)
            carry[c] = F.first(d, ignorenulls=True).over(past)
        elif s.kind == "last":
            local[l] = F.last(v, ignorenulls=True).over(upto)
            carry[c] = F.last(d, ignorenulls=True).over(past)
        elif s.kind == "last_before":
            local[l] = F.last(v, ignorenulls=True).over(before)
            carry[c] = F.last(d, ignorenulls=True).over(past)
        elif s.kind == "previous":
            local[l] = F.lag(v).over(inner)
            carry[c] = F.last(d, ignorenulls=True).over(past)
        elif s.kind == "next":
            local[l] = F.last(v, ignorenulls=True).over(from_here)
            carry[c] = F.last(d, ignorenulls=True).over(ahead)
        elif s.kind == "following":
            local[l] = F.lag(v).over(down)
            carry[c] = F.last(d, ignorenulls=True).over(ahead)
        pick = F.min_by if s.kind == "first" or backwards else F.max_by
        digest.append(pick(F.col(v), at).alias(d))
        near, far = (F.col(c), F.col(l)) if s.kind == "first" else (F.col(l), F.col(c))
        joined = F.coalesce(near, far)
        final[name] = joined["v"] if s.kind in ("previous", "following") else joined

    if bucket is None:
        base = df.withColumns(held)
    else:
        base = df.withColumn("_bucket", bucket).withColumns(held).repartition(*[F.col(c) for c in group])
    summary = base.groupBy(*group).agg(*digest).select(*group, *[e.alias(n) for n, e in carry.items()])
    rest = [c for c in df.columns if c != "_bucket"]
    # the summary grows with the table, however small its file looks, so it is never sent whole through the driver
    return base.withColumns(local).join(dealt(summary), group, "left").withColumns(final).select(*rest, *out, *(["_bucket"] if keep_bucket else []))


def number_rows(df: DataFrame, keys: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """Zero-based position of every row inside its group."""
    return scan(df, keys, bucket, order, {name: running_sum(F.lit(1).cast("long"))}).withColumn(
        name, (F.col(name) - F.lit(1)).cast("long")
    )
