"""The near-duplicate stage of the pipeline against a comparison of all pairs."""

import random
import sys

import pytest
from pyspark.sql import functions as F
from touchline.llm import common, similar
from touchline.llm.simhash import fingerprint


def plain_kept(texts):
    """Smallest id of each component of texts that share 0.8 of their shingles of five words."""
    sets = {i: similar.shingles((t or "").encode()) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            both, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if i < j and (both / union >= 0.8 if union else True):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in texts}


def altered(words, rng, changes):
    words = list(words)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("usual, block", [(1, 512), (1, 4), (16, 512)])
def test_near_copies_are_those_of_all_pairs(spark, monkeypatch, usual, block):
    monkeypatch.setattr(similar, "USUAL", usual)
    monkeypatch.setattr(similar, "BLOCK", block)
    rng, texts = random.Random(4), []
    for _ in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([50, 100, 200]))]
        texts += [" ".join(words)] + [altered(words, rng, c) for c in (1, 1, 2, 3, 8)]
    base = [f"b{rng.randrange(5000)}" for _ in range(120)]
    far = altered(base, rng, 5)
    texts += [altered(base, rng, 2) for _ in range(30)] + [altered(far.split(), rng, c) for c in (0, 1, 2, 2, 3)] + [altered(base, rng, 6) for _ in range(8)] + [" ".join(base), None, "", " \n", "one two", "One  two", "one three"]
    rng.shuffle(texts)
    data = dict(enumerate(texts))
    df = spark.createDataFrame(list(data.items()), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"] for r in similar.drop_similar(df).collect()}
    assert got == plain_kept(data) and len(got) < len(data)


def test_odd_rows(odd, empty):
    got = similar.drop_similar(odd)
    assert got.columns == odd.columns and got.count() == 8 and similar.drop_similar(empty).count() == 0


def test_fingerprints_link_texts_that_share_no_band(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = [" ".join(base)] + [altered(base, rng, c) for c in (1, 1, 1, 2, 2, 4, 40)] + ["  ".join(base), "other words"]
    rows = common.numbered(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1))
    sets = similar._signatures(rows, similar.SHINGLE).withColumn("bands", F.array().cast("array<bigint>"))
    of = {r[common.ROW]: r["text"].encode() for r in rows.collect()}
    got = {(r["a"], r["b"]) for r in similar.links(sets.select(common.ROW, "fp", "bands", "sketch"), rows).collect()}
    bits = lambda a, b: ((fingerprint(of[a], 5) ^ fingerprint(of[b], 5)) & (1 << 64) - 1).bit_count()
    near = {(a, b) for a in of for b in of if a < b and bits(a, b) <= similar.BITS and similar.alike(*(similar.shingles(of[x]) for x in (a, b)))}
    assert any(4 < bits(a, b) for a, b in near) and len({x for p in near for x in p}) > 4
    copies = {(a, b) for a, b in near if bits(a, b) == 0}  # sets of one fingerprint meet their first only
    firsts = {p for p in near if not any(b in p for _, b in copies)}
    assert got == firsts | copies


def test_a_step_lets_go_of_what_others_kept():
    common.kept("a table", list)
    common.forget()
    assert not sys.__dict__["_kept_by_tasks"]
