"""Removal of repeated passages against all windows."""

import collections
import hashlib
import random

import duckdb
import pyarrow as pa
import pytest

from touchline.llm import passages
from touchline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, window=20):
    """(doc_id, n_words, n_removed, digest) of rows (doc_id, text) in the order they are read."""
    words = [(t or "").encode().split() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, gone = set(), [set() for _ in rows]
    for k in order:
        for at in range(len(words[k]) - window + 1):
            shown = tuple(words[k][at : at + window])
            if shown in seen:
                gone[k].update(range(at, at + window))
            seen.add(shown)
    return [(i, len(w), len(g), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in g)).hexdigest()) for (i, _), w, g in zip(rows, words, gone)]


def got(df):
    return collections.Counter(tuple(r)[:4] for r in df.collect())


def test_passages(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want = plain(rows)
    assert got(QUERIES["op13_passages"](spark, SF)) == collections.Counter(want) and sum(w[2] > 0 for w in want) > 5


def test_passages_of_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = passages.remove_passages(odd).collect()
    want = plain(rows)
    assert collections.Counter(tuple(r)[1:4] for r in found) == collections.Counter(w[1:] for w in want)
    assert passages.remove_passages(empty).count() == 0


@pytest.mark.parametrize("shard_words, block_docs", [(400_000, 2_000), (30, 3)])
def test_random_phrases(spark, shard_words, block_docs):
    """Few words, so windows overlap, repeat inside a text, and share parts; small shards and blocks."""
    rng = random.Random(shard_words)
    phrases = [[rng.choice("abcd") for _ in range(rng.randrange(4, 40))] for _ in range(12)]
    texts = [" ".join(w for _ in range(rng.randrange(1, 8)) for w in rng.choice(phrases)) for _ in range(120)]
    texts += ["a " * 90, "a " * 31, "a b " * 40, " ".join(map(str, range(60))), "x " + " ".join(map(str, range(60))) + " y", texts[0]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = passages.remove_passages(df, window=12, shard_words=shard_words, block_docs=block_docs)
    assert got(found) == collections.Counter(plain(rows, 12))
    words = dict((r["doc_id"], r["kept"]) for r in found.collect())
    assert words[124] == b"x y" and words[0] is None or words[0] != texts[0].encode()


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(passages, "_PART", 64)
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(1500)]
    rows = [(1, " ".join(words + words[200:300])), (2, " ".join(words[900:950])), (3, "short")]
    assert got(passages.remove_passages(spark.createDataFrame(rows, "doc_id long, text string"))) == collections.Counter(plain(rows))


def test_windows_of_many_texts_are_handed_on_together():
    """Texts of a batch are one run of words; their windows and neighbours stay within their own text."""
    words, parts = [b"a b c d e f", b"c d e", b"b c d e"], [[(0, 2, False), (3, 1, False)], [(0, 1, False)], [(0, 2, True)]]
    kind = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("alike", pa.bool_())]))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7, 8, 9]), pa.array([1, None, 3], pa.int64()), pa.array(words), pa.array([[dict(zip(("at", "n", "alike"), p)) for p in ps] for ps in parts], kind)],
        names=[passages.ROW, "doc_id", "words", "parts"],
    )
    (found,) = passages._window_rows([batch], 3)
    rows = found.to_pylist()
    assert [(r[passages.ROW], r["doc_id"], r["at"], r["n"]) for r in rows] == [(7, 1, 0, 1), (7, 1, 1, 1), (7, 1, 3, 1), (8, None, 0, 1), (9, 3, 0, 2)]
    assert [(r["before"] != 0, r["after"] != 0) for r in rows] == [(False, True), (True, True), (True, False), (False, False), (False, False)]
    assert rows[0]["d1"] == xxhash_of(b"a b c") and rows[3]["d1"] == xxhash_of(b"c d e") and rows[4]["d1"] == xxhash_of(b"b c d e")


def xxhash_of(text):
    return int.from_bytes(passages.xxhash.xxh3_128_digest(text)[:8], "little", signed=True)
