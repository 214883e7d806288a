"""Near copies by the share of word shingles in common: SimHash fingerprints link most, MinHash bands find the pairs
whose fingerprints differ too much, and each pair is verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from touchline.llm import simhash
from touchline.llm.common import ROW, byte_texts, forget, numbered, skew_join, slices, spread_lookup
from touchline.llm.components import connected
from touchline.llm.simhash import fingerprint
from touchline.session import durable

SHINGLE = 5
SIMILARITY = 0.8
#: differing bits of linked fingerprints; of so many at most one falls in some segment
BITS = 5
#: bands and hashes in each; a pair of the least similarity shares no band with a chance of (1 - 0.8^5)^25, about 5e-5
BANDS, WIDE = 25, 5
#: equal hashes of all that a pair must have to be verified; a pair of the least similarity has fewer with a chance of 1e-6
LIKELY = 78
#: bands with more members than this are linked through hubs first
USUAL = 16
#: members of one side of a cell
BLOCK = 512
_CHUNK = 1 << 13
#: bytes of texts that a task holds as Python values
_PART = 1 << 22


def shingles(text: bytes, shingle: int = SHINGLE) -> set[bytes]:
    """Distinct runs of words in lower case; a shorter text is one run, one without words has none."""
    words = text.lower().split()
    if len(words) <= shingle:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))


def alike(a: set[bytes], b: set[bytes], least: float = SIMILARITY) -> bool:
    """Whether the sets share at least this part of their union."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both)


def _signatures(rows: DataFrame, shingle: int) -> DataFrame:
    """``rows`` with the digest of the shingle set, its fingerprint, bands and a byte of each hash in place of the text."""
    schema = rows.drop("text").schema.add("key", "binary").add("fp", "long").add("bands", ArrayType(LongType())).add("sketch", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(11)
        times, plus = rng.integers(0, 1 << 64, (2, BANDS * WIDE, 1), dtype=np.uint64)
        times |= np.uint64(1)
        forget()
        for batch in (part for whole in batches for part in slices(whole, "text", _PART)):
            keys, fps, bands, sketches = [], [], [], []
            for text in byte_texts(batch.column("text")):
                parts = shingles(text, shingle)
                hashes = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts)))
                keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                fps.append(fingerprint(text, shingle))
                least = np.full(BANDS * WIDE, np.iinfo(np.uint64).max)
                for at in range(0, len(hashes), _CHUNK):
                    least = np.minimum(least, (hashes[at : at + _CHUNK] * times + plus).min(axis=1))
                bands.append([xxhash.xxh64_intdigest(band.tobytes(), i) - (1 << 63) for i, band in enumerate(least.reshape(BANDS, WIDE))] if len(hashes) else [])
                sketches.append((least >> np.uint64(32)).astype(np.uint8).tobytes())
            rest = [n for n in batch.schema.names if n != "text"]
            found = [pa.array(keys, pa.binary()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *found], names=[*rest, "key", "fp", "bands", "sketch"])

    return rows.mapInArrow(run, schema)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * WIDE)


def _likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches agree often enough. A hub may be the a of many pairs."""
    sketch = sets.select(F.col(ROW).alias("a"), F.col("sketch").alias("_a"))
    met = spread_lookup(pairs, ["a"], sketch, "b").join(sets.select(F.col(ROW).alias("b"), F.col("sketch").alias("_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = pa.array((_sketches(batch.column("_a")) == _sketches(batch.column("_b"))).sum(axis=1) >= LIKELY)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return met.select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts are alike; most others are left out by their sketches before any text moves."""
    likely = durable(_likely(durable(pairs, "pairs"), sets), "likely")
    served = spread_lookup(likely, ["a"], texts.select(F.col(ROW).alias("a"), F.col("text").alias("_a")), "b")
    served = served.join(texts.select(F.col(ROW).alias("b"), F.col("text").alias("_b")), "b").select("a", "b", "_a", "_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in (part for whole in batches for part in slices(whole, "_a", _PART)):
            keep = []
            columns = (batch.column("a").to_pylist(), byte_texts(batch.column("_a")), byte_texts(batch.column("_b")))
            for i, (a, left, right) in enumerate(zip(*columns)):
                if a != last:
                    last, held = a, shingles(left, shingle)
                if alike(held, shingles(right, shingle), least):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    return served.mapInArrow(run, "a long, b long")


def _cells(placed: DataFrame) -> DataFrame:
    """Rows (cell, band, left, ROW, root) of hot bands whose members lie in several components.

    A band's largest component is not compared with itself: the left side of its cells are blocks of the other members,
    the right side blocks of all members, and every left block meets every right one.
    """
    of = placed.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band")
    split = of.agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.count("*").alias("roots")).where("roots > 1")
    split = durable(split.select("band", F.col("main.root").alias("main"), "all", F.ceil((F.col("all") - F.col("main.n")) / BLOCK).cast("int").alias("xs"), F.ceil(F.col("all") / BLOCK).cast("int").alias("ys")), "split")
    members = durable(skew_join(placed, ["band"], split, split, "all", ROW), "members")
    own = F.xxhash64(ROW)
    left = members.where("root <> main").withColumns({"left": F.lit(True), "x": F.pmod(own, F.col("xs")), "y": F.explode(F.sequence(F.lit(0), F.col("ys") - 1))})
    right = members.withColumns({"left": F.lit(False), "x": F.explode(F.sequence(F.lit(0), F.col("xs") - 1)), "y": F.pmod(own, F.col("ys"))})
    return left.unionByName(right).select(F.xxhash64("band", "x", "y").alias("cell"), "band", "left", ROW, "root")


def _compared(batches: Iterator[pa.RecordBatch], shingle: int, least: float, exact: bool) -> Iterator[pa.RecordBatch]:
    """Compare the two sides of cells that come sorted, left side first: not ``exact``, which members have a likely
    partner under the first band they share; else verified links, at most one fewer than components in the cell."""
    cell, left, sketches, bands, sets, parent = None, [], None, None, [], {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    names = ["cell", "band", "left", ROW, "root", "bands", "sketch", *(["text"] if exact else [])]
    for batch in batches:
        out, said = [], set()
        for key, band, is_left, row, own, mine, sketch, *text in zip(*(batch.column(c).to_pylist() for c in names)):
            if key != cell:
                cell, left, sketches, parent, sets = key, [], None, {}, []
            mine, sketch = np.array(mine), np.frombuffer(sketch, np.uint8)
            if is_left:
                left.append((row, own, mine, sketch))
                sets.append(shingles(text[0].encode() if text[0] else b"", shingle) if exact else None)
                continue
            if not left:
                continue
            if sketches is None:
                bands, sketches = np.array([x[2] for x in left]), np.array([x[3] for x in left])
            near = np.flatnonzero((sketches == sketch).sum(axis=1) >= LIKELY)
            held = None
            for i in near.tolist():
                other, apart = left[i][:2]
                shared = bands[i] == mine
                if other == row or apart == own or mine[np.argmax(shared)] != band or root(apart) == root(own):
                    continue
                if not exact:
                    out += [(cell, band, True, other, apart), (cell, band, False, row, own)]
                    continue
                held = held if held is not None else shingles(text[0].encode() if text[0] else b"", shingle)
                if alike(held, sets[i], least):
                    parent[root(apart)] = root(own)
                    out.append((min(row, other), max(row, other)))
        if exact:
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        else:
            said = sorted(set(out))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in said], t) for k, t in enumerate(kinds)], names=names[:5])


def _by_fingerprint(sets: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Verified pairs (a, b) of the first sets of fingerprints that differ in few bits, and of each set with the first of its own."""
    firsts = durable(sets.groupBy("fp").agg(F.min(ROW).alias("a")), "fingerprints")
    same = spread_lookup(sets.select("fp", ROW), ["fp"], firsts, ROW).where(F.col(ROW) != F.col("a")).select("a", F.col(ROW).alias("b"))  # the first is the least row
    met = simhash.links(firsts.select("fp"), BITS).select(F.col("a").alias("fp"), F.col("b").alias("_fp"))
    met = met.join(firsts, "fp").join(firsts.select(F.col("fp").alias("_fp"), F.col("a").alias("b")), "_fp")
    return _verified(same.unionByName(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), sets, texts, shingle, least)


def links(sets: DataFrame, texts: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """Verified pairs (a, b) of ``sets`` (ROW, fp, bands, sketch) that join all that share bands and reach each other.

    Fingerprints link what they can; bands then give the other pairs. A band of few members gives all its pairs. Members of larger ones are first compared with one hub each, the member of all
    their bands whose bands are the most common. Then the members of a band that are not in its largest
    component are compared with all others in cells of two blocks, which give at most one link per member.
    """
    found = durable(_by_fingerprint(sets, texts, shingle, least), "linked")
    index = sets.select(ROW, F.explode("bands").alias("band"))
    sizes = durable(index.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "bands")
    usual = index.join(sizes.where(F.col("n") <= USUAL), "band").select("band", ROW)
    met = usual.join(usual.withColumnRenamed(ROW, "_other"), "band").where(F.col(ROW) < F.col("_other"))
    met = met.select(F.col(ROW).alias("a"), F.col("_other").alias("b")).distinct().join(found, ["a", "b"], "left_anti")
    found = durable(found.unionByName(_verified(met, sets, texts, shingle, least)), "links")
    often = durable(sizes.where(F.col("n") > USUAL), "often")
    if often.isEmpty():
        return found
    hot = skew_join(index, ["band"], often, often, "n", ROW).groupBy(ROW).agg(F.collect_list("band").alias("hot"), F.sum("n").alias("score"))
    hot = durable(hot, "hot")

    def placed() -> DataFrame:
        roots = connected(found).withColumnRenamed("node", ROW)
        return durable(hot.join(roots, ROW, "left").select(F.explode("hot").alias("band"), ROW, F.coalesce("root", ROW).alias("root"), "score"), "placed")

    apart = placed()
    hubs = durable(apart.groupBy("band").agg(F.max(F.struct("score", ROW, "root")).alias("hub"), F.count("*").alias("n")), "hubs")
    pairs = skew_join(apart, ["band"], hubs.select("band", "hub"), hubs, "n", ROW).where(F.col("hub.root") != F.col("root"))
    pairs = pairs.groupBy(ROW).agg(F.max("hub").alias("hub")).select(F.col(f"hub.{ROW}").alias("a"), F.col(ROW).alias("b"))
    found = durable(found.unionByName(_verified(pairs, sets, texts, shingle, least)), "links")
    cells = durable(_cells(placed()), "cells")
    if cells.isEmpty():
        return found

    def compared(rows: DataFrame, exact: bool, schema: str) -> DataFrame:
        laid = rows.repartition("cell").sortWithinPartitions("cell", F.col("left").desc())
        return laid.mapInArrow(lambda b: _compared(b, shingle, least, exact), schema)

    marks = sets.select(ROW, "bands", "sketch")
    likely = compared(cells.join(marks, ROW), False, f"cell long, band long, left boolean, {ROW} long, root long").distinct()
    likely = durable(likely, "likely")
    more = compared(likely.join(marks, ROW).join(texts, ROW), True, "a long, b long")
    return durable(found.unionByName(more), "links")


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component of similar texts: the one with the smallest doc_id.

    Two texts are linked if their sets of shingles share at least ``least`` of the union; texts without words are
    copies of each other. A null doc_id comes after all others; of repeated rows the first read stays.
    """
    texts = numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    rows = durable(_signatures(texts, shingle), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))
    first = rows.groupBy("key").agg(F.min(order).alias("first"))
    sets = first.join(rows.select(F.col(ROW).alias("_r"), "fp", "bands", "sketch"), F.col("first.row") == F.col("_r"))
    sets = durable(sets.select("key", "first", F.col("_r").alias(ROW), "fp", "bands", "sketch"), "sets")
    roots = connected(links(sets.select(ROW, "fp", "bands", "sketch"), texts.select(ROW, "text"), shingle, least)).withColumnRenamed("node", ROW)
    placed = sets.select("first", ROW).join(roots, ROW, "left").withColumn("root", F.coalesce("root", ROW))
    kept = placed.groupBy("root").agg(F.min("first").alias("least")).select(F.col("least.row").alias("_kept"))
    return numbered(docs, "_number").join(kept, F.col("_number") == F.col("_kept"), "left_semi").select(*docs.columns)
