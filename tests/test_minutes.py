"""Corrections, orientation, supersede, metadata."""

import pytest
from pyspark.sql import functions as F

from touchline.functions.colours import parse_colour
from touchline.functions.counters import COUNTERS, split_adjustment
from touchline.operators import export, ingest, minutes as mn, rulesets

SCHEMA = "match_id string, half int, minute int, " + ", ".join(f"{c} int" for c in COUNTERS) + ", revision int, superseded int"


def table(spark, rows):
    return spark.createDataFrame([(m, h, n, *(list(v) + [0] * (10 - len(v))), 0, s) for m, h, n, v, s in rows], SCHEMA)


def test_correction_then_cumulative(spark):
    rows = table(spark, [("m", 1, 1, (100, 50), 0), ("m", 1, 2, (80, 70), 0)])
    fix = spark.createDataFrame([("m", 1, 1, "flip_to", 1, 10), ("m", 1, 9, "drop", 0, 5)], "match_id string, half int, minute int, kind string, team_id int, frames int")
    done = mn.apply_corrections(rows, fix)
    first = done.filter("minute = 1").first()
    assert (first.frames_team_a, first.frames_team_b, first.revision) == (90, 60, 1) and done.count() == 2
    total = mn.cumulative_read(done, F.lit(1), F.lit(2)).first()
    assert (total.frames_team_a, total.frames_team_b) == (170, 130)


def test_supersede_is_idempotent(spark):
    rows = table(spark, [("m", 1, i, (100,), 0) for i in (1, 2, 3)])
    reset = spark.createDataFrame([("m", 1, 2)], "match_id string, upto_half int, upto_minute int")
    once = mn.supersede(rows, reset)
    assert mn.superseded_count([rows], reset).first().n == 2 and mn.superseded_count([once], reset).count() == 0
    assert mn.cumulative_read(once, F.lit(1), F.lit(3)).first().frames_team_a == 100
    assert mn.supersede(once, reset).collect() == once.collect()


@pytest.mark.parametrize("n, carry, want", [(5, 0, (0, 5, 0)), (10, 8, (8, 2, 0)), (3, 8, (3, 0, 5))])
def test_split(spark, n, carry, want):
    assert tuple(spark.range(1).select(split_adjustment(F.lit(n), F.lit(carry)).alias("s")).first().s) == want


@pytest.mark.parametrize(
    "last, clip, want",
    [((None, None), (1, 1), True), ((1, 0), (1, 1), True), ((1, 0), (1, 2), False), ((1, 7), (1, 8), True), ((1, 7), (1, 9), False), ((1, 20), (2, 1), True), ((1, 20), (2, 2), False)],
)
def test_ordering(spark, last, clip, want):
    args = [F.lit(v).cast("int") for v in (*last, *clip)]
    assert spark.range(1).select(ingest.is_expected(*args).alias("ok")).first().ok is want


def requests(spark, rows):
    schema = "match_id string, seq bigint, request string, " + ", ".join(f"{c} string" for c in ingest.TEAM_FIELDS)
    return spark.createDataFrame([("m", i, r.get("request", "clip"), *[r.get(f) for f in ingest.TEAM_FIELDS]) for i, r in enumerate(rows)], schema)


@pytest.mark.parametrize("size", [4096, 1])
def test_generation(spark, size):
    rows = [
        {"team_a_name": "Reds", "team_a_colour": None},
        {"team_a_colour": "#FF6600"},
        {"team_a_colour": "ff6600", "team_a_name": "Other"},
        {"team_a_colour": "blue", "team_b_gk_colour": "lime"},
        {"team_b_gk_colour": "teal", "team_a_colour": "red"},
        {"request": "reset", "team_a_name": "New"},
        {"team_a_name": "Late"},
    ]
    out = ingest.evolve_metadata(requests(spark, rows), size).orderBy("seq").collect()
    assert [r.fit_generation for r in out] == [1, 1, 1, 2, 3, 4, 4]
    assert [r.team_a_name for r in out] == ["Reds"] * 5 + ["New"] * 2
    assert out[-1].team_a_colour == "red"


def test_reset_of_unknown_match_is_ignored(spark):
    out = ingest.evolve_metadata(requests(spark, [{"request": "reset"}, {"team_a_name": "X"}])).collect()
    assert [(r.seq, r.fit_generation) for r in out] == [(1, 1)]


def test_bad_colour(spark):
    df = spark.createDataFrame([("mauve",)], "c string")
    assert df.select(parse_colour(F.col("c")).alias("p")).first().p is None
    with pytest.raises(Exception, match="unrecognised colour"):
        df.select(parse_colour(F.col("c"), strict=True)).collect()


def test_unknown_ruleset(spark):
    with pytest.raises(Exception, match="unknown ruleset"):
        rulesets.with_ruleset(spark.createDataFrame([("beach",)], "ruleset string"), "ball_conf").collect()


def test_export_names(spark):
    m = spark.createDataFrame([("m", "", None)], "match_id string, team_a_name string, team_b_name string")
    assert tuple(export.team_names(m).first()) == ("m", "Team 0", "Team 1")
