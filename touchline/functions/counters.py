"""Counter arithmetic, labels and small text rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
COUNTERS = [
    "frames_team_a",
    "frames_team_b",
    "frames_loose",
    "frames_oof",
    "passes_completed_team_a",
    "passes_completed_team_b",
    "interceptions_team_a",
    "interceptions_team_b",
    "ball_lost_team_a",
    "ball_lost_team_b",
]
# fixed values: event names in the log
EVENT_KINDS = {"completed": "pass", "interception": "interception", "ball_lost": "ball_lost"}


def wire_key(counter: str) -> str:
    """Name of a counter in the delivered body."""
    return counter.replace("_team_", "_")


def adjust(kind: Column, team: Column, n: Column, a: Column, b: Column, oof: Column) -> Column:
    """Struct a, b, oof after moving up to ``n`` frames.

    ``flip_to`` moves them from the other team to ``team``; ``drop`` from ``team`` to oof.
    """
    first = team == 0
    source = F.when((kind == "flip_to") == first, b).otherwise(a)
    moved = F.when((n > 0) & kind.isin("flip_to", "drop"), F.least(n, source)).otherwise(F.lit(0))
    flip = F.when(kind == "flip_to", moved).otherwise(F.lit(0))
    drop = moved - flip
    gain_a, gain_b = F.when(first, flip).otherwise(-flip), F.when(first, -flip).otherwise(flip)
    loss_a, loss_b = F.when(first, drop).otherwise(F.lit(0)), F.when(first, F.lit(0)).otherwise(drop)
    return F.struct(
        (a + gain_a - loss_a).cast("long").alias("a"),
        (b + gain_b - loss_b).cast("long").alias("b"),
        (oof + drop).cast("long").alias("oof"),
    )


def split_adjustment(n: Column, carry: Column) -> Column:
    """Struct prior, current, rest: the part owed to the minute before comes first."""
    prior = F.least(n, carry)
    return F.struct(prior.alias("prior"), (n - prior).alias("current"), (carry - prior).alias("rest"))


def event_kind(kind: Column) -> Column:
    return F.replace(kind, F.lit("completed"), F.lit("pass"))


def flip_team(team: Column) -> Column:
    return F.when(team.isin(0, 1), 1 - team).otherwise(team)


def minute_label(half: Column, minute: Column) -> Column:
    return F.format_string("H%d_M%02d", half, minute)


def block_label(half: Column, block: Column) -> Column:
    return F.format_string("H%d_B%02d", half, block)


def safe_filename(name: Column) -> Column:
    """Letters, digits, ``-`` and ``_`` stay; anything else becomes ``_``."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")


def share(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """``scale * part / whole``, 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.lit(scale) * part / whole)
