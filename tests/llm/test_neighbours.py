"""Nearest vectors against a comparison with all rows."""

import math

import numpy as np

from touchline.llm import neighbours

SF = "/root/testdata/sf0.01"


def exact(vectors, query, nearest=20):
    scores = {i: float(np.cumsum(vectors[query] * v)[-1]) for i, v in vectors.items() if i != query}
    return sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:nearest]


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in table.collect()}
    got = results(neighbours.search(table))
    assert set(got) == {i for i in vectors if i % 20 == 0}
    hits = 0
    for query, found in got.items():
        want = exact(vectors, query)
        assert len(found) == 20 and found == sorted(found, key=lambda s: (-s[1], s[0]))
        assert all(math.isclose(s, float(vectors[query] @ vectors[i]), rel_tol=1e-12, abs_tol=1e-12) for i, s in found)
        hits += len({i for i, _ in found} & {i for i, _ in want})
    assert hits >= 0.9 * 20 * len(got)


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    data = [(i, [1.0, 2.0]) for i in range(60)] + [(60, [2.0, 4.0]), (60, [2.0, 4.0]), (61, None), (62, [0.0, 0.0]), (63, [float("nan"), 1.0]), (80, [None, 1.0]), (100, [float("inf"), 1.0]), (None, [1.0, 1.0]), (120, [3.0])]
    df = spark.createDataFrame([(i, v, 3, 1) for i, v in data], "vec_id long, embedding array<float>, leaf int, score int")
    vectors = {i: np.array(v) for i, v in data if i is not None and i <= 60}
    got = results(neighbours.search(df))
    assert got == {q: exact(vectors, q) for q in (0, 20, 40, 60)}
    assert neighbours.search(df.limit(0)).count() == 0
    assert results(neighbours.search(df.where("vec_id in (0, 1)"))) == {0: [(1, 5.0)]}


def test_traversal_visits_every_leaf_once():
    tree = neighbours.grow(np.random.default_rng(1).normal(size=(500, 8)))
    order = tree.visits(np.ones(8), tree.leaves)
    assert sorted(order) == list(range(tree.leaves)) and tree.visits(np.ones(8), 3) == order[:3]


def test_queries_of_a_leaf_are_cut(spark, monkeypatch):
    """All vectors are equal and in one leaf; no group may hold all of its queries."""
    whole = neighbours.best_of

    def bounded(ids, x, query_ids, q, nearest):
        if len(q) > 60:
            raise ValueError(f"{len(q)} queries in one group")
        return whole(ids, x, query_ids, q, nearest)

    monkeypatch.setattr(neighbours, "best_of", bounded)
    monkeypatch.setattr(neighbours, "CALIBRATION", 10)
    monkeypatch.setattr(neighbours, "QUERIES", 20, raising=False)
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(400)], "vec_id long, embedding array<double>")
    got = results(neighbours.search(df, every=2, nearest=3))
    assert got == {q: [(i, 5.0) for i in [i for i in range(4) if i != q][:3]] for q in range(0, 400, 2)}


def test_depth_grows_with_the_table():
    assert [neighbours.levels_for(n) for n in (0, 128_000, 128_001, 20_000_000)] == [2, 2, 3, 5]
