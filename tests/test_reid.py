"""Claims of lost ids along time."""

import pytest

from touchline.operators import reid

RAW = "match_id string, raw_id long, first long, last long, embedding array<double>, digits string, verdict boolean, shots array<struct<sharpness:double,arrival:long,embedding:array<double>>>, number struct<digits:string,conf:double>"
A, B, NEAR_A = [1.0, 0.0], [0.0, 1.0], [1.0, 0.2]


def track(raw, first, last, vector, digits=None, verdict=None, number=None, sharp=100.0, match="m"):
    return (match, raw, first, last, vector, digits, verdict, [(sharp, raw, vector)], number)


TRACKS = [
    track(1, 0, 10, A, number=("7", 0.9)),
    track(2, 0, 12, B),
    # both look like 1, one frame apart: the first takes it
    track(3, 100, 150, NEAR_A),
    track(4, 101, 160, A),
    # two in one frame ask for id 0, which 3 gave back at 150
    track(5, 300, 320, NEAR_A),
    track(6, 300, 330, A),
    # another number
    track(7, 500, 510, A, digits="9"),
    # gone for too long, and not gone for long enough
    track(8, 3000, 3010, A),
    track(9, 3040, 3050, A),
    # in doubt: the verdict decides
    track(10, 3200, 3210, [1.0, 1.0], verdict=True),
    track(11, 3201, 3210, [1.0, 1.0]),
    track(12, 0, 5, A, match="other"),
]


@pytest.mark.parametrize("size", [16384, 128])
def test_an_id_has_one_claimant_at_a_time(spark, size):
    rows = reid.claims(spark.createDataFrame(TRACKS, RAW), 50, 1000, size=size, warmup=64).collect()
    got = {r["raw_id"]: (r["stable_id"], r["candidate_id"], r["event"], r["matched"], r["vetoed"]) for r in rows}
    high, no = "reid_high_conf", (None, None, False, False)
    assert got[1] == (0, *no) and got[2] == (1, *no) and got[12] == (0, *no)
    assert got[3] == (0, 0, high, True, False)
    # 0 is taken and 1 looks different
    assert got[4] == (2, 1, "reid_below_threshold", False, False)
    # id 0 is back with the look of 3; of equal likeness the smaller id is asked, and the more alike of two gets it
    assert got[5] == (0, 0, high, True, False) and got[6] == (3, 0, None, False, False)
    assert got[7] == (4, 0, high, False, True)
    assert got[8] == (5, *no) and got[9] == (6, *no)
    assert got[10] == (5, 5, "reid_vlm_checked", True, False) and got[11] == (7, 6, "reid_vlm_skipped_no_ref", False, False)
    assert {r["new_id"] for r in rows if r["match_id"] == "m"} == {None, *range(8)}


def test_merges_follow_time(spark):
    pairs = [("m", 5, 2, 3), ("m", 9, 2, 3), ("m", 7, 1, 3), ("m", 8, 1, 2), ("m", 6, 4, 9), ("n", 1, 0, 1)]
    rows = reid.merge_events(spark.createDataFrame(pairs, "match_id string, frame_idx long, a long, b long")).collect()
    assert sorted(map(tuple, rows)) == [("m", 5, 2, 3), ("m", 6, 4, 9), ("m", 7, 1, 2), ("n", 1, 0, 1)]


def test_empty(spark):
    assert reid.claims(spark.createDataFrame([], RAW), 50, 1000).count() == 0
