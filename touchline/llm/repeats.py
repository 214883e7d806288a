"""Repeated byte strings: anchors gather what may be equal, a Burrows-Wheeler transform decides."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import ROW, byte_texts, flat_bytes, kept, numbered, ranges, skew_join, slices, spread_lookup
from touchline.session import durable

LEAST = 400
#: bytes of an anchor
GRAM = 32
#: bytes of segments that one transform takes; a context with more is decided by digests of its strings
MOST_BYTES = 1 << 20
#: bytes handled at once when anchors are looked for, small enough for a processor's cache
_PART = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    def make() -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    size = max(2 * _PART, 1 << n.bit_length())
    return kept(f"powers {base} {size}", make)[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


def half_context(least: int, gram: int = GRAM) -> int:
    return least - (least - gram) // 2


def anchored(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, gram: int = GRAM):
    """Segments of consecutive string starts: first start, number of starts, place of the context they share.

    The anchor of a string of ``least`` bytes is the place of the smallest hash of ``gram`` bytes in it, the first
    of equal ones. Its context is the anchor with the bytes after it, or, for an anchor in the string's second
    half, those before it, ``half_context(least)`` bytes that lie within the string either way. Both
    depend on the string alone, so equal strings have equal contexts.
    """
    empty = np.zeros(0, np.int64)
    n = len(data)
    if n < least:
        return empty, empty, np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, n), out=sums[1:])
    grams = _mixed((sums[gram:] - sums[:-gram]) * _powers(_INVERSE, n - gram + 1))
    low = np.uint64((1 << 24) - 1)
    place = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    window, width = least - gram + 1, 1
    while 2 * width <= window:
        place = np.minimum(place[:-width], place[width:])
        width *= 2
    if width < window:
        place = np.minimum(place[: len(place) - (window - width)], place[window - width :])
    anchor = (place & low).astype(np.int64)
    lengths = np.diff(offsets)
    inside = np.zeros(len(anchor), bool)
    usable = lengths >= least
    inside[ranges(offsets[:-1][usable], lengths[usable] - least + 1)] = True
    side = (anchor - np.arange(len(anchor)) <= (least - gram) // 2).astype(np.int8)
    begins = inside & np.r_[True, (anchor[1:] != anchor[:-1]) | (side[1:] != side[:-1])]
    begins[offsets[:-1][usable]] = True
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(inside & np.r_[begins[1:] | ~inside[1:], True]) + 1
    half = half_context(least, gram)
    return starts, ends - starts, np.where(side[starts], anchor[starts], anchor[starts] + gram - half)


def segments(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """Row, 64-bit digests of the context and of all bytes, first start and number of starts of every segment."""
    half, digest = half_context(least), xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, _PART):
                rows = part.column(ROW).to_numpy()
                data, offsets = flat_bytes(part.column(text))
                # a text beyond the part size is read in overlapping pieces
                for lo in range(0, max(1, len(data) - least + 1), _PART if len(rows) == 1 else max(1, len(data))):
                    hi = min(len(data), lo + _PART + least - 1) if len(rows) == 1 else len(data)
                    cut = np.array([0, hi - lo]) if len(rows) == 1 else offsets
                    starts, counts, contexts = anchored(data[lo:hi], cut, least)
                    of = np.searchsorted(cut, starts, side="right") - 1
                    raw = data[lo:hi].tobytes()
                    keys = [digest(raw[c : c + half]) for c in contexts.tolist()]
                    whole = [digest(raw[s : s + m + least - 1]) for s, m in zip(starts.tolist(), counts.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(rows[of], pa.int64()),
                            pa.array(np.array(keys, np.uint64).view(np.int64)),
                            pa.array(np.array(whole, np.uint64).view(np.int64)),
                            pa.array(starts - cut[of] + lo, pa.int64()),
                            pa.array(counts.astype(np.int32)),
                        ],
                        names=[ROW, "context", "digest", "start", "starts"],
                    )

    return docs.select(ROW, text).mapInArrow(run, f"{ROW} long, context long, digest long, start long, starts int")


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of their keys, ties by place, and where in that order a new key begins."""
    packed = np.sort((key << bits) | np.arange(len(key)))
    places, keys = packed & ((1 << bits) - 1), packed >> bits
    return places, np.r_[True, keys[1:] != keys[:-1]]


def transform(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes by their first ``least`` symbols at least, and the symbols before them.

    Symbols are at most 256, and the last one is 0; a suffix ends in zeros.
    """
    n = len(symbols)
    bits = n.bit_length()
    if bits > 21:
        raise ValueError("three places must fit into 63 bits")
    reach = (63 - bits) // 9
    padded = np.r_[symbols, np.zeros(reach, np.int64)]
    key = np.zeros(n, np.int64)
    for i in range(reach):
        key = (key << 9) | padded[i : n + i]
    rank = np.empty(n, np.int64)
    while True:
        order, new = _sorted(key, bits)
        rank[order] = np.cumsum(new)
        if reach >= least or new.all():
            return order, symbols[order - 1]
        key = rank << bits
        key[: n - reach] |= rank[reach:]
        reach *= 2


def long_common(order: np.ndarray, before: np.ndarray, least: int) -> np.ndarray:
    """For each place in the order: whether the prefix shared with the place before has ``least`` symbols.

    Breadth-first over intervals of the transform: level d holds the intervals of strings of d symbols,
    extended by one symbol in front at a time. An interval whose end no earlier level has marked gives a common
    prefix of exactly d there; what is not marked before level ``least`` is at least that long. Work is
    in proportion to the intervals that still mark something.
    """
    n = len(order)
    bits = n.bit_length()
    # a symbol's first place plus its rank: the place of the suffix that begins with the symbol before
    step = np.empty(n, np.int64)
    step[_sorted(before, bits)[0]] = np.arange(n)
    open_ = np.ones(n + 1, bool)
    open_[0] = open_[n] = False
    lo, hi = np.array([0]), np.array([n])
    for _ in range(least):
        if not len(lo):
            break
        sizes = hi - lo
        place = ranges(lo, sizes)
        by, new = _sorted((np.repeat(np.arange(len(lo)), sizes) << 9) | before[place], bits)
        heads = np.flatnonzero(new)
        new_hi = step[place[by[heads]]] + np.diff(np.r_[heads, len(by)])
        fresh = open_[new_hi]
        open_[new_hi] = False
        hi = new_hi[fresh]
        lo = hi - np.diff(np.r_[heads, len(by)])[fresh]
    return open_[:n]


def repeated_starts(parts: list[bytes], least: int = LEAST) -> list[np.ndarray]:
    """For each segment, which of its string starts occur at another place of any segment of the list."""
    sizes = np.array([len(p) for p in parts])
    borders = np.cumsum(sizes + 1) - 1
    data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64) + 1
    data[borders] = 0  # no start has a border among its symbols, so one border symbol is enough
    order, before = transform(data, least)
    long_ = long_common(order, before, least)
    again = np.zeros(len(data), bool)
    again[order[long_]] = True
    again[order[np.r_[long_[1:], False]]] = True
    firsts = borders - sizes
    return [again[f : f + s - least + 1] for f, s in zip(firsts.tolist(), sizes.tolist())]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_WANTED = "array<struct<context:bigint,start:bigint,starts:int>>"
_MARKS = f"{ROW} long, start long, starts int"


def _cut(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text."""
    for batch in batches:
        for row, text, wanted in zip(batch.column(ROW).to_pylist(), byte_texts(batch.column("text")), batch.column("wanted").to_pylist()):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([w["context"] for w in wanted], pa.int64()),
                    pa.array([row] * len(wanted), pa.int64()),
                    pa.array([w["start"] for w in wanted], pa.int64()),
                    pa.array([text[w["start"] : w["start"] + w["starts"] + least - 1] for w in wanted], pa.binary()),
                ],
                names=["context", ROW, "start", "bytes"],
            )


def _decide(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Repeated starts of segments that come sorted by context, whole contexts at a time."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def decide(group: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        rows, firsts, counts = [], [], []
        for (_, row, start, _b), flags in zip(group, repeated_starts([g[3] for g in group], least)):
            for lo, hi in zip(*_runs(flags)):
                rows.append(row)
                firsts.append(start + int(lo))
                counts.append(int(hi - lo))
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(firsts, pa.int64()), pa.array(counts, pa.int32())], names=[ROW, "start", "starts"])

    for batch in batches:
        for item in zip(*(batch.column(c).to_pylist() for c in ("context", ROW, "start", "bytes"))):
            if size >= MOST_BYTES // 2 and held[-1][0] != item[0]:
                yield decide(held)
                held, size = [], 0
            held.append(item)
            size += len(item[3])
    if held:
        yield decide(held)


def _strings(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """A 128-bit digest for every string of the segments of very common contexts."""
    for batch in batches:
        for row, start, part in zip(*(batch.column(c).to_pylist() for c in (ROW, "start", "bytes"))):
            n = len(part) - least + 1
            digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(part[i : i + least]) for i in range(n)]), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, row)), pa.array(np.arange(start, start + n)), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy())],
                names=[ROW, "start", "d1", "d2"],
            )


def repeated_marks(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Row, first start and number of starts of the strings that occur at more than one place.

    ``docs`` needs a number per row and ``text``. It is handed on whole to the step that cuts segments, so that a
    caller who joins the marks to ``docs`` has one exchange of the texts. Segments with equal context and digest are one class, counted
    before any bytes move; all of a class with several members repeats. Only classes whose context
    has other classes too are compared byte by byte, each class once, through the transform.
    """
    found = durable(segments(docs, "text", least), "segments")
    member = F.struct(F.col(ROW).alias("row"), "start", "starts")
    classes = durable(found.groupBy("context", "digest").agg(F.count("*").alias("members"), F.min(member).alias("one")), "classes")
    contexts = classes.groupBy("context").agg(F.count("*").alias("kinds"), F.sum(F.col("one.starts") + (least - 1)).alias("bytes"))
    shared = contexts.where(F.col("kinds") > 1)
    wanted = (
        spread_lookup(classes, ["context"], shared, "digest")
        .where(F.col("kinds").isNotNull())
        .groupBy(F.col("one.row").alias(ROW))
        .agg(F.collect_list(F.struct("context", "one.start", "one.starts", (F.col("bytes") > MOST_BYTES).alias("many"))).alias("wanted"))
    )
    cut = docs.join(wanted, ROW)

    def bytes_of(many: bool) -> DataFrame:
        some = F.transform(F.filter("wanted", lambda w: w["many"] == F.lit(many)), lambda w: F.struct(w["context"].alias("context"), w["start"].alias("start"), w["starts"].alias("starts")))
        return (
            cut.select(*docs.columns, some.alias("wanted"))
            .where(F.size("wanted") > 0)
            .mapInArrow(lambda b: _cut(b, least), f"context long, {ROW} long, start long, bytes binary")
        )

    once = bytes_of(False).repartition("context").sortWithinPartitions("context").mapInArrow(lambda b: _decide(b, least), _MARKS)
    again = classes.where("members > 1").select("context", "digest", "members")
    copies = skew_join(found, ["context", "digest"], again.select("context", "digest"), again, "members", "start").select(ROW, "start", "starts")
    marks = once.unionByName(copies)
    if not shared.where(F.col("bytes") > MOST_BYTES).isEmpty():
        strings = bytes_of(True).mapInArrow(lambda b: _strings(b, least), f"{ROW} long, start long, d1 long, d2 long")
        strings = durable(strings, "strings")
        often = strings.groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1")
        many = spread_lookup(strings, ["d1", "d2"], often, ROW).where(F.col("n").isNotNull())
        marks = marks.unionByName(many.select(ROW, "start", F.lit(1).alias("starts")))
    return marks


def _remove(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, spans, whole = [], [], [], []
        for text, marks in zip(byte_texts(batch.column("text")), batch.column("marks").to_pylist()):
            runs: list[list[int]] = []
            for m in sorted(marks or [], key=lambda m: m["start"]):
                lo, hi = m["start"], m["start"] + m["starts"] - 1 + least
                if runs and lo <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], hi)
                else:
                    runs.append([lo, hi])
            left = b"".join(text[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(text)]))
            kept.append(left)
            whole.append(len(text))
            removed.append(len(text) - len(left))
            spans.append(len(runs))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(whole, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode(errors="replace") for k in kept], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"],
        )


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Each document without the bytes of strings of ``least`` bytes that start anywhere else too.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the text kept, in which a character cut in two by a removed
    string is a replacement sign (the digest is of the bytes). Matches never cross
    documents; overlaps count; the input decides, not what is left. Null and empty texts keep nothing; repeated
    rows remove each other's strings; a null doc_id is a document like any other; an empty table gives
    an empty result.
    """
    rows = numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    marks = repeated_marks(rows, least).groupBy(ROW).agg(F.collect_list(F.struct("start", "starts")).alias("marks"))
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    return rows.join(marks, ROW, "left").select("doc_id", "text", "marks").mapInArrow(lambda b: _remove(b, least), schema)
