"""Importance resampling towards a target: array-scored weights, then a cutoff found by bisection over exact counts."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import ROW, byte_texts, numbered
from touchline.session import durable

BUCKETS = 10_000
#: words in the longest feature
RUN = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: halvings of a range whose midpoints are counted by one job
HALVINGS = 4
#: bytes of a text handled at once
_PART = 1 << 20

#: lower-cases A-Z and turns every ASCII character that is in no word into a space
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def features(text: bytes, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """Number of words and buckets of the features that end in them, for one part of the text after the other."""
    text = text.translate(_WORDS)
    before: list[bytes] = []
    at = 0
    while at < len(text):
        end = text.find(b" ", at + _PART)
        end = len(text) if end < 0 else end
        fresh = text[at:end].split()
        at, words = end, before + fresh
        # the checksum of a run of words goes on from that of the run without its last word
        spaced, sums, found = list(map(b" ".__add__, words)), list(map(zlib.crc32, words)), []
        for more in range(RUN):
            if more:
                sums = list(map(zlib.crc32, spaced[more:], sums))
            found += sums[max(0, len(before) - more) :]
        before = words[1 - RUN :]
        yield len(fresh), np.fromiter(found, np.int64, len(found)) % buckets


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket: one row per partition and bucket is shuffled, ``buckets`` reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in byte_texts(batch.column(0)):
                for _, found in features(raw, buckets):
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the target's and the source's smoothed shares of each bucket, rounded down."""
    wide, big = len(source), (int(source.sum()), int(target.sum()))
    return np.array([math.floor(1000 * math.log((t + 1) * (big[0] + wide) / ((s + 1) * (big[1] + wide)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def draw(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise of a document, in thousandths; a null id draws as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(rows: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """ROW, doc_id, n_words, n_features, weight and score of every row; ``gain`` is one number per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            for doc_id, raw in zip(ids, byte_texts(batch.column(text))):
                words = number = weight = 0
                for n, found in features(raw, len(gain)):
                    words, number, weight = words + n, number + len(found), weight + int(gain[found].sum())
                out.append((words, number, weight, weight + draw(doc_id)))
            columns = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names=[ROW, "doc_id", "n_words", "n_features", "weight", "score"])

    return rows.select(ROW, "doc_id", text).mapInArrow(run, f"{ROW} long, doc_id long, n_words long, n_features long, weight long, score long")


def nth_least(values: DataFrame, column: str, n: int) -> tuple[int, int]:
    """The n-th least value (from 1) of a whole-number column and how many values are less.

    Bisection: each job counts the values up to the midpoints that the next ``HALVINGS`` halvings can ask for, so it
    takes 64 / HALVINGS jobs at most, each a scan of one stored column, and nothing but counts leaves them.
    """
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi, less = ends["lo"], ends["hi"], 0
    while lo < hi:
        step = max(1, (hi - lo + 1) >> HALVINGS)
        marks = list(range(lo + step - 1, hi, step))
        counts = values.agg(*(F.count_if(F.col(column) <= m).alias(f"c{i}") for i, m in enumerate(marks))).first()
        for m, c in zip(marks, counts):
            if c >= n:
                hi = m
                break
            lo, less = m + 1, c
    return lo, less


def highest(table: DataFrame, n: int) -> Column:
    """Condition for the ``n`` rows of highest score, ties to the smaller doc_id (null last), then the smaller ROW."""
    keys = [(-F.col("score")), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0)), F.col(ROW)]
    inside, tied = F.lit(False), F.lit(True)
    for key in keys:
        value, less = nth_least(table.where(tied).select(key.alias("key")), "key", n)
        inside, tied, n = inside | (tied & (key < value)), tied & (key == value), n - less
        if n == table.where(tied).count():
            break
    return inside | tied


def ranked(chosen: DataFrame) -> DataFrame:
    """ROW and rank of the rows in order of score, doc_id and ROW: ranges are sorted apart, their sizes are added up."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col(ROW)]
    parts = chosen.repartitionByRange(*order).sortWithinPartitions(*order).select(ROW, F.monotonically_increasing_id().alias("_place"))
    parts = durable(parts.select(ROW, F.shiftright("_place", 33).alias("_range"), F.col("_place").bitwiseAND((1 << 33) - 1).alias("_at")), "ranks")
    sizes = parts.groupBy("_range").agg(F.count("*").alias("n"))
    # one row per range
    bases = sizes.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_base"))
    return parts.join(bases, "_range").select(ROW, (F.col("_base") + F.col("_at") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Draw ``percent`` of the documents with at least ``least_words`` words, those most like ``target`` with noise.

    Returns doc_id, n_features, weight, score and rank (null if not drawn) of every row. Features are runs of up to
    ``RUN`` words in ``BUCKETS`` buckets of their checksum; all rows of ``docs`` and ``target`` count. Ids must be
    whole numbers. Null and empty texts have no feature, weight 0 and are never drawn; a null id comes after all others
    of its score; repeated rows are drawn like others; tables may be empty.
    """
    rows = numbered(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    gain = gains(bucket_counts(rows), bucket_counts(target.select(F.col(text).alias("text"))))
    table = durable(scored(rows, gain), "scores")
    able = table.where(F.col("n_words") >= least_words)
    n = able.count() * percent // 100
    chosen = able.where(highest(able, n)) if n else able.where(F.lit(False))
    return table.join(ranked(chosen), ROW, "left").select("doc_id", "n_features", "weight", "score", "rank")
