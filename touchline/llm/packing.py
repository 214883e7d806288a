"""Packing documents into sequences: bin completion on the table of lengths, then numbered places."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import ROW, byte_texts, numbered, slices
from touchline.llm.word_tokens import coder
from touchline.session import durable

CAPACITY = 4096
END = 1
#: steps of the search, a sequence filled or a part of a filling tried, after which the best packing so far counts
STEPS = 100_000
#: sequences of the branch at hand, from its end, whose remaining options stay in memory
OPEN = 64

#: a sequence layout: how often it is used, and its lengths
Layout = tuple[int, tuple[int, ...]]


def token_pieces(docs: DataFrame, tokenizer_path: str, end: int = END, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """doc_id, row, piece, start, length and checksum of the pieces of every text.

    Null text counts as empty and is the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, wide = coder(tokenizer_path), end.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            for part in slices(batch, text, 4 << 20):
                out: list[tuple[int, int, int, int, int]] = []
                from_, number = [], 0
                for row, raw in zip(part.column(ROW).to_pylist(), byte_texts(part.column(text))):
                    ids = words.encode(raw) + last
                    for i, at in enumerate(range(0, len(ids), wide)):
                        piece = ids[at : at + wide]
                        out.append((row, i, at // 4, len(piece) // 4, zlib.crc32(piece)))
                        from_.append(number)
                    number += 1
                columns = zip(*out)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                found = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(from_, pa.int64())), *found], names=["doc_id", ROW, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", ROW, text).mapInArrow(run, f"doc_id {kind}, {ROW} long, piece int, start long, length long, ids_crc32 long")


def least_bins(counts: np.ndarray) -> int:
    """No packing has fewer sequences. ``counts[n]`` is the number of pieces of length n; the last is the capacity.

    For each limit k: pieces over capacity - k stand without any of length k or more, so what pieces from
    k up waste there cannot be used.
    """
    capacity = len(counts) - 1
    sizes = np.arange(capacity + 1)
    number, total = np.cumsum(counts[::-1])[::-1], np.cumsum((counts * sizes)[::-1])[::-1]
    half = capacity // 2
    best = -(-int(total[0]) // capacity)
    over_half = int(number[half + 1]) if half < capacity else 0
    k = np.arange(1, half + 1)
    if len(k):
        big = number[capacity - k + 1]
        room = (over_half - big) * capacity - (total[half + 1] - total[capacity - k + 1])
        rest = total[k] - total[half + 1] - room
        best = max(best, over_half + max(0, int((-(-rest // capacity)).max())))
    return best


def best_fit(counts: np.ndarray) -> list[Layout]:
    """Best-fit decreasing on counts: pieces of one length go to all sequences of one layout at a time."""
    capacity = len(counts) - 1
    # sequences by room left: layout and how many have it
    by_room: list[list[list]] = [[] for _ in range(capacity + 1)]
    rooms = np.zeros(capacity + 1, bool)
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            fits = np.flatnonzero(rooms[size:])
            if not len(fits):
                each = capacity // size
                full, rest = divmod(left, each)
                for times, items in ((full, each), (1, rest)):
                    if times and items:
                        room = capacity - items * size
                        by_room[room].append([times, (size,) * items])
                        rooms[room] = True
                break
            room = size + int(fits[0])
            times, layout = by_room[room].pop()
            used = min(times, left)
            if times > used:
                by_room[room].append([times - used, layout])
            rooms[room] = bool(by_room[room])
            by_room[room - size].append([used, (*layout, size)])
            rooms[room - size] = True
            left -= used
    return [(times, layout) for group in by_room for times, layout in group]


def _copies(sums: int, size: int, times: int) -> int:
    """Bit set of the sums with up to ``times`` pieces of a length added."""
    step = 1
    while times:
        part = min(step, times)
        sums |= sums << (size * part)
        times -= part
        step *= 2
    return sums


class _Reach:
    """Which totals the lengths up to half a sequence can have; row i is by the i smallest lengths."""

    def __init__(self, counts: np.ndarray):
        capacity = len(counts) - 1
        self.sizes = np.flatnonzero(counts[: capacity // 2 + 1])
        self.by = np.zeros((len(self.sizes) + 1, capacity + 1), bool)
        self.by[0, 0] = True
        for i, size in enumerate(self.sizes.tolist()):
            row = self.by[i + 1]
            row[:] = self.by[i]
            times, step = min(int(counts[size]), capacity // size), 1
            while times:
                part = min(step, times) * size
                row[part:] |= row[:-part].copy()
                times -= min(step, times)
                step *= 2


def _fillings(left: np.ndarray, gap: int, reach: _Reach, budget: list[int]) -> Iterator[tuple[int, ...]]:
    """All undominated ways to fill a gap, least waste first, then larger parts first.

    A filling is dominated if pieces of it can give way to one other piece that is no smaller than
    their sum and fits in their place. ``reach`` may be of more pieces than are left. Ends early only when
    ``budget`` is used up.
    """
    fits = np.flatnonzero(left[: gap + 1])
    fits = fits[fits > 0]
    if not len(fits):
        yield ()
        return
    single = int(fits[-1])
    free = sum(1 << n for n in fits.tolist())
    top = int(np.searchsorted(reach.sizes, gap, side="right"))

    def parts(rest: int, upto: int, waste: int, sums: int, others: int) -> Iterator[tuple[int, ...]]:
        if not rest:
            yield ()
            return
        near = np.arange(min(upto, int(np.searchsorted(reach.sizes, rest, side="right"))))
        sizes = reach.sizes[near]
        near = near[reach.by[near + 1, rest - sizes] & (left[sizes] > 0)]
        for i in near[::-1].tolist():
            size = int(reach.sizes[i])
            apart = others & ~(1 << size)
            could, step, more = apart, 1, waste
            while more:
                could |= could >> min(step, more)
                more -= min(step, more)
                step *= 2
            for times in range(min(int(left[size]), rest // size), 0, -1):
                budget[0] -= 1
                if budget[0] < 0:
                    return
                if not reach.by[i, rest - times * size]:
                    continue
                more = _copies(sums, size, times)
                if more & ~1 & could:
                    continue
                for tail in parts(rest - times * size, i, waste, more, apart):
                    yield (size,) * times + tail

    for total in np.flatnonzero(reach.by[top, : gap + 1])[::-1].tolist():
        if total <= single:
            break
        yield from parts(total, top, gap - total, 1, free)
        if budget[0] < 0:
            return
    yield (single,)


def _options(left: np.ndarray, top: int, reach: _Reach, budget: list[int]) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Fillings beside the largest piece and how often each is used: as often as can be, half as often, ..., once.

    ``left`` is the search's own: it may change while the generator waits, but has to be as at first whenever it goes on.
    """
    fillings = _fillings(left, len(left) - 1 - top, reach, budget)
    while True:
        left[top] -= 1
        filling = next(fillings, None)
        left[top] += 1
        if filling is None:
            return
        layout = (top, *filling)
        held, need = np.unique(layout, return_counts=True)
        times = int((left[held] // need).min())
        while times:
            yield times, layout
            times //= 2


def complete(counts: np.ndarray, steps: int = STEPS) -> list[Layout]:
    """Bin completion: fill up the sequence of the largest piece, again and again, and back up where it wastes.

    The best solution so far starts as best-fit decreasing; a branch ends as soon as its sequences and
    the least number for the rest are no fewer. Passes allow ever more departures from the first option of each sequence,
    until the lower bound is met, the tree is exhausted (the packing is then the least there is) or
    ``steps`` are used up.
    """
    best = best_fit(counts)
    fewest, least = sum(t for t, _ in best), least_bins(counts)
    left, budget, allowed, cut = counts.astype(np.int64), [steps], 0, True
    root = _Reach(left) if fewest > least else None

    while cut and fewest > least and budget[0] >= 0:
        cut, bins, used = False, 0, []
        # largest piece, options, next option's number, departures before, reach, lengths when it was made, what the option has taken
        stack: list[list] = []
        reach, held = root, np.count_nonzero(left)
        spent, down = 0, True
        while budget[0] >= 0 and fewest > least:
            if down:
                budget[0] -= 1
                pieces = np.flatnonzero(left)
                if not len(pieces):
                    if bins < fewest:
                        best, fewest = list(used), bins
                    down = False
                elif bins + least_bins(left) >= fewest:
                    down = False
                else:
                    if len(pieces) < 0.8 * held:
                        reach, held = _Reach(left), len(pieces)
                    stack.append([int(pieces[-1]), None, 0, spent, reach, held, None])
                    if len(stack) > OPEN:
                        # enumerated anew should the search come back so far
                        stack[-OPEN - 1][1] = None
            if not stack:
                break
            frame = stack[-1]
            top, options, number, spent, reach, held, taken = frame
            if taken:
                sizes, need, times = taken
                left[sizes] += need * times
                bins -= times
                used.pop()
                frame[6] = None
            if spent + number > allowed:
                cut, option = True, None
            else:
                if options is None:
                    frame[1] = options = islice(_options(left, top, reach, budget), number, None)
                option = next(options, None)
            if option is None:
                stack.pop()
                down = False
                continue
            times, layout = option
            sizes, need = np.unique(layout, return_counts=True)
            left[sizes] -= need * times
            bins += times
            used.append((times, layout))
            frame[2], frame[6] = number + 1, (sizes, need, times)
            spent, down = spent + number, True
        for frame in stack:
            if frame[6]:
                sizes, need, times = frame[6]
                left[sizes] += need * times
        allowed = 2 * allowed or 1
    return best


def places(layouts: list[Layout]) -> dict[str, np.ndarray]:
    """For each length its numbered pieces' places: from this number on, first sequence, pieces per sequence, offset."""
    rows, sequence, taken = [], 0, {}
    for times, layout in layouts:
        offset = 0
        sizes, per = np.unique(layout, return_counts=True)
        for size, n in zip(sizes.tolist(), per.tolist()):
            rows.append((size, taken.get(size, 0), sequence, n, offset))
            taken[size] = taken.get(size, 0) + times * n
            offset += size * n
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "number", "sequence", "per", "offset"), table.T))


def pack(pieces: DataFrame, capacity: int = CAPACITY, steps: int = STEPS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; sequences hold at most ``capacity`` tokens.

    ``pieces`` needs ROW, piece (their pair unique) and length (1 to ``capacity``) and is read twice, so
    it should be a written table. Only the number of pieces of each length, at most ``capacity`` numbers, comes to
    the driver; the layouts made from it are as bounded. Pieces of one length are numbered in buckets, so
    that a length of a third of all pieces is spread. An empty table gives an empty result.
    """
    counted = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in counted:
        counts[r["length"]] = r["n"]
    plan = places(complete(counts, steps))
    buckets = int(min(1 << 16, max(32, counts.sum() // 50_000)))
    key = F.pmod(F.xxhash64(ROW, "piece"), F.lit(buckets)).cast("int")
    bucketed = pieces.withColumn("_bucket", key)
    sizes = bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(ROW, "piece")) - 1
    ranked = bucketed.withColumn("_within", within).join(bases, ["length", "_bucket"])
    ranked = ranked.withColumn("_number", F.col("_base") + F.col("_within")).drop("_bucket", "_within", "_base")
    names = [c for c in ranked.columns if c != "_number"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(plan["length"]):
            return
        wide = int(plan["number"].max()) + 1
        index = plan["length"] * wide + plan["number"]
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("_number").to_numpy()
            at = np.searchsorted(index, length * wide + np.minimum(number, wide - 1), side="right") - 1
            nth, slot = np.divmod(number - plan["number"][at], plan["per"][at])
            where = [pa.array(plan["sequence"][at] + nth), pa.array(plan["offset"][at] + slot * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *where], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    Repeated rows and null ids are packed like others. Null and empty texts are the end id alone.
    """
    rows = numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    pieces = durable(token_pieces(rows, tokenizer_path), "pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
