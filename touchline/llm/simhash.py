"""Near duplicates: 64-bit SimHash fingerprints, linked through one-wildcard segment variants."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import ROW, byte_texts, numbered, spread_lookup
from touchline.llm.components import connected
from touchline.session import durable

SHINGLE = 4
MOST_BITS = 4
#: first bit and width of each segment; of MOST_BITS differing bits at most one falls in some segment
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: variants with more members than this are compared in pairs of blocks of this size
BLOCK = 1024
_CHUNK = 1 << 20


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits as a signed integer; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), parts), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            of = np.bincount(part[:, byte], minlength=256)
            counts[8 * byte : 8 * byte + 8] += of @ _BITS
    bits = counts * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


#: bit i of every byte value
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``fp`` in place of ``text``. Null text counts as empty."""
    schema = docs.drop(text).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(x, shingle) for x in byte_texts(batch.column(text))], pa.int64())
            rest = [name for name in batch.schema.names if name != text]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in rest] + [fps], names=[*rest, "fp"])

    return docs.mapInArrow(run, schema)


def variants(fps: DataFrame) -> DataFrame:
    """Index rows (key, fp): each segment with each of its bits left open.

    The key holds segment, open bit and the remaining bits, so equal keys mean that the segments differ
    in that bit at most.
    """
    opened = []
    for k, (at, width) in enumerate(SEGMENTS):
        segment = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            masked = segment.bitwiseAND(F.lit(~(1 << bit) & ((1 << width) - 1)))
            opened.append(masked + F.lit(((k << 5) + bit) << 22))
    return fps.select("fp", F.explode(F.array(*opened)).alias("key"))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _opened(key: np.ndarray, diff: np.ndarray) -> np.ndarray:
    """Whether this key is the first under which a pair with these differing bits meets."""
    number = (key >> 22).astype(np.int64)
    first = np.full(len(diff), -1, np.int64)
    for k, (at, width) in reversed(list(enumerate(SEGMENTS))):
        part = (diff >> np.uint64(at)) & np.uint64((1 << width) - 1)
        near = _popcount(part) <= 1
        bit = np.where(part == 0, 0, np.round(np.log2(np.maximum(part, 1).astype(np.float64)))).astype(np.int64)
        first[near] = ((k << 5) + bit)[near]
    return first == number


def _forest(fps: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join all members of one variant that reach each other, one fewer than members."""
    left = np.arange(len(fps))
    a, b = [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            parent = np.full(len(left), -1)
            for at in range(0, len(front), 256):
                part = front[at : at + 256]
                near = _popcount(fps[left][None, :] ^ fps[part][:, None]) <= most
                hit = near.any(axis=0) & (parent < 0)
                parent[hit] = part[near.argmax(axis=0)[hit]]
            got = parent >= 0
            a.append(parent[got])
            b.append(left[got])
            front, left = left[got], left[~got]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]).astype(np.int64), np.concatenate([none, *b]).astype(np.int64)


def _pairs(keys: np.ndarray, fps: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys. Small runs give each pair once over all keys, large ones a forest."""
    fps = fps.view(np.uint64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    out_a, out_b = [], []
    small = np.repeat(sizes <= 32, sizes)
    for step in range(1, min(32, int(sizes.max(initial=0)))):
        i = np.flatnonzero((keys[step:] == keys[:-step]) & small[:-step])
        if not len(i):
            break
        diff = fps[i] ^ fps[i + step]
        i, diff = (x[_popcount(diff) <= most] for x in (i, diff))
        i = i[_opened(keys[i], diff)]
        out_a.append(fps[i])
        out_b.append(fps[i + step])
    for s, n in zip(starts[sizes > 32], sizes[sizes > 32]):
        run = fps[s : s + n]
        a, b = _forest(run, most)
        out_a.append(run[a])
        out_b.append(run[b])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *out_a]).view(np.int64), np.concatenate([none, *out_b]).view(np.int64)


def _verify(batches: Iterator[pa.RecordBatch], most: int = MOST_BITS) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by key; a run that a batch cuts waits for the next batch."""
    rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        a, b = _pairs(k, f, most)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        k = np.concatenate([rest_k, batch.column("key").to_numpy()])
        f = np.concatenate([rest_f, batch.column("fp").to_numpy()])
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1]))
        yield links(k[:cut], f[:cut])
        rest_k, rest_f = k[cut:], f[cut:]
    yield links(rest_k, rest_f)


def links(fps: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that differ in ``most`` bits at most (5 with these segments) and join all that reach each other.

    ``fps`` is a table of distinct ``fp``. A variant with more than ``BLOCK`` members is cut into blocks, and
    each pair of blocks is compared on its own, so no group grows beyond two blocks and no link is lost.
    """
    index = variants(fps)
    sizes = index.groupBy("key").agg(F.count("*").alias("members"))
    hot = sizes.where(F.col("members") > BLOCK).select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    hot = durable(hot, "hot")
    usual = index.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    schema = "a long, b long"
    found = usual.mapInArrow(partial(_verify, most=most), schema)
    if not hot.isEmpty():
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        cells = (
            index.join(hot, "key")
            .withColumn("block", block)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("x", F.least("block", "other"))
            .withColumn("y", F.greatest("block", "other"))
        )
        cells = cells.select(F.xxhash64("key", "x", "y").alias("key"), "fp").repartition("key").sortWithinPartitions("key")
        found = found.unionByName(cells.mapInArrow(partial(_verify_cells, most=most), schema))
    return found


def _verify_cells(batches: Iterator[pa.RecordBatch], most: int = MOST_BITS) -> Iterator[pa.RecordBatch]:
    """As ``_verify`` for pairs of blocks, whose links are always given as a forest."""
    rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in _ended(batches):
        if batch is not None:
            rest_k = np.concatenate([rest_k, batch.column("key").to_numpy()])
            rest_f = np.concatenate([rest_f, batch.column("fp").to_numpy()])
        cut = len(rest_k) if batch is None else int(np.searchsorted(rest_k, rest_k[-1])) if len(rest_k) else 0
        starts = np.flatnonzero(np.r_[True, rest_k[1:cut] != rest_k[: cut - 1]]) if cut else np.zeros(0, np.int64)
        for s, e in zip(starts, np.r_[starts[1:], cut]):
            run = rest_f[s:e].view(np.uint64)
            a, b = _forest(run, most)
            yield pa.RecordBatch.from_arrays([pa.array(run[a].view(np.int64)), pa.array(run[b].view(np.int64))], names=["a", "b"])
        rest_k, rest_f = rest_k[cut:], rest_f[cut:]


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Each row with fingerprint and component: row, doc_id, fp, component_id, first_row.

    ``component_id`` is the smallest doc_id of all texts reachable over links, itself included;
    ``first_row`` the row that has it (of repeated rows the first read). A null doc_id comes after all others.
    Null and empty texts have fingerprint zero and are linked like any other. Exact copies share one
    fingerprint and count once in the index. An empty table gives an empty result.
    """
    rows = numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    rows = durable(fingerprints(rows, shingle=shingle), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))
    distinct = durable(rows.groupBy("fp").agg(F.min(first).alias("first")), "distinct")
    roots = connected(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = placed.groupBy("root").agg(F.min("first").alias("least"))
    # a component may hold a third of all fingerprints
    named = spread_lookup(placed.select("fp", "root"), ["root"], groups, "fp").select(
        "fp", F.col("least.id").alias("component_id"), F.col("least.row").alias("first_row")
    )
    return spread_lookup(rows, ["fp"], named, ROW).select(ROW, "doc_id", "fp", "component_id", "first_row")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id."""
    gone = near_groups(docs, doc_id, text, shingle).where(F.col(ROW) != F.col("first_row")).select(F.col(ROW).alias("_gone"))
    return numbered(docs, "_number").join(gone, F.col("_number") == F.col("_gone"), "left_anti").select(*docs.columns)
