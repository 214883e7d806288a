"""Importance resampling against a plain version."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import pytest

from touchline.llm import resampling
from touchline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_features(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs, target):
    """(doc_id, features, weight, score, rank) of all (doc_id, text)."""
    found = [plain_features(t) for _, t in docs]
    s, t = collections.Counter(), collections.Counter()
    for _, f in found:
        s.update(f)
    for text in target:
        t.update(plain_features(text)[1])
    big = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big[0] + 10_000) / ((s[b] + 1) * (big[1] + 10_000)))) for b in range(10_000)}
    out = []
    for (i, _), (_, f) in zip(docs, found):
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((-r[3], r[0] is None, r[0] or 0, k) for k, (r, (n, _)) in enumerate(zip(out, found)) if n >= 20)
    for rank, key in enumerate(able[: len(able) * 5 // 100], 1):
        out[key[3]][4] = rank
    return collections.Counter(map(tuple, out))


def test_resampling(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    target = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    got = collections.Counter(map(tuple, QUERIES["op11_resampling"](spark, SF).collect()))
    assert got == plain(docs, target) and sum(1 for r in got if r[4]) > 5


def test_resampling_of_odd_rows(spark, odd, empty):
    target = spark.createDataFrame([("word1 token1. word2",), (None,), ("",)], "text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert collections.Counter(map(tuple, resampling.resample(odd, target).collect())) == plain(rows, ["word1 token1. word2"])
    assert resampling.resample(empty, target).count() == 0
    assert resampling.resample(odd, target.limit(0)).count() == len(rows)


@pytest.mark.parametrize("part", [1, 40, 1 << 20])
def test_features_in_parts(monkeypatch, part):
    monkeypatch.setattr(resampling, "_PART", part)
    text = "The CAT's 12 mats, über-alles\x00x   é 日本 A b\nC. " * 20
    parts = list(resampling.features(text.encode()))
    n, want = plain_features(text)
    assert sum(p[0] for p in parts) == n and sorted(b for p in parts for b in p[1].tolist()) == sorted(want)


def test_ties_go_to_the_smaller_id(spark):
    """All scores equal: ids decide, then the place of repeated rows; ranks cover several ranges."""
    df = spark.createDataFrame([(k, k % 97, 5 * (k % 2)) for k in range(2000)], "_row long, doc_id long, score long")
    chosen = df.where(resampling.highest(df, 317))
    want = sorted(((-(5 * (k % 2)), k % 97, k) for k in range(2000)))[:317]
    assert {r["_row"] for r in chosen.collect()} == {w[2] for w in want}
    assert {r["_row"]: r["rank"] for r in resampling.ranked(chosen).collect()} == {w[2]: i for i, w in enumerate(want, 1)}
    assert resampling.nth_least(df, "doc_id", 1) == (0, 0) and resampling.nth_least(df, "_row", 2000) == (1999, 1999)
