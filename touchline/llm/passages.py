"""Repeated windows of words: recurring passages are confirmed, compiled into automata, and located in all documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import ROW, byte_texts, numbered, ranges, skew_join, slices
from touchline.llm.repeats import _BASE, _BYTE, _INVERSE, _mixed, _powers
from touchline.session import durable

WINDOW = 20
#: words of an anchor
GRAM = 8
#: words of the passages in one automaton, about
SHARD_WORDS = 400_000
#: documents that one automaton reads in one go, about
BLOCK_DOCS = 2_000
#: words handled at once when anchors are looked for
_PART = 1 << 17
#: bytes of texts whose windows are handed on at once
_TEXTS = 1 << 21


def plain_words(raw: bytes) -> bytes:
    """Words joined by one space."""
    return b" ".join(raw.split())


def anchored(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of consecutive windows: first window, number of windows, hash of the run of ``gram`` words they share,
    and first and last byte of each.

    ``data`` is words with one space between them, ``offsets`` the first word of every document and the number of
    words. The anchor of a window is the run with the smallest hash in it, the first of equal ones, so equal windows
    have equal anchors.
    """
    empty = np.zeros(0, np.int64)
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.r_[0, spaces + 1], np.r_[spaces, len(data)]
    n = len(starts)
    if n < window or not len(data):
        return empty, empty, np.zeros(0, np.uint64), np.zeros((2, 0), np.int64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=sums[1:])
    first, last = starts[: n - gram + 1], ends[gram - 1 :]
    grams = _mixed((sums[last] - sums[first]) * _powers(_INVERSE, len(data))[first])
    low = np.uint64((1 << 20) - 1)
    place = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    wide, width = window - gram + 1, 1
    while 2 * width <= wide:
        place = np.minimum(place[:-width], place[width:])
        width *= 2
    if width < wide:
        place = np.minimum(place[: len(place) - (wide - width)], place[wide - width :])
    anchor = (place & low).astype(np.int64)
    lengths = np.diff(offsets)
    usable = lengths >= window
    inside = np.zeros(len(anchor), bool)
    inside[ranges(offsets[:-1][usable], lengths[usable] - window + 1)] = True
    begins = inside & np.r_[True, anchor[1:] != anchor[:-1]]
    begins[offsets[:-1][usable]] = True
    heads = np.flatnonzero(begins)
    stops = np.flatnonzero(inside & np.r_[begins[1:] | ~inside[1:], True]) + 1
    return heads, stops - heads, grams[anchor[heads]], np.array([starts[heads], ends[stops + window - 2]])


def segments(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """ROW, anchor, digest of all words, first window and number of windows of every segment of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[bytes] = []
            of: list[tuple[int, int]] = []
            offsets = [0]
            for row, raw in zip(batch.column(ROW).to_pylist(), byte_texts(batch.column("text"))):
                words = raw.split()
                # a long text is read in parts that overlap by a window less one word
                for at in range(0, len(words) - window + 1, _PART):
                    part = words[at : at + _PART + window - 1]
                    if offsets[-1] + len(part) > 2 * _PART and held:
                        yield found(held, of, offsets)
                        held, of, offsets = [], [], [0]
                    held.append(b" ".join(part))
                    of.append((row, at))
                    offsets.append(offsets[-1] + len(part))
            if held:
                yield found(held, of, offsets)

    def found(held: list[bytes], of: list[tuple[int, int]], offsets: list[int]) -> pa.RecordBatch:
        bounds, where = np.array(offsets), np.array(of)
        data = b" ".join(held)
        heads, counts, grams, (first, last) = anchored(np.frombuffer(data, np.uint8), bounds, window)
        text = np.searchsorted(bounds, heads, side="right") - 1
        digests = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(heads))
        columns = [where[text, 0], grams.view(np.int64), digests.view(np.int64), (heads - bounds[text] + where[text, 1]).astype(np.int32), counts.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[ROW, "anchor", "digest", "at", "n"])

    return rows.select(ROW, "text").mapInArrow(run, f"{ROW} long, anchor long, digest long, at int, n int")


def suspects(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """ROW, doc_id, n_words and digest of every text; where some anchor occurs more than once, also the words and those segments."""
    parts = segments(rows, window)
    counts = parts.groupBy("anchor").agg(F.count("*").alias("often"), (F.min("digest") == F.max("digest")).alias("alike")).where("often > 1")
    counts = durable(counts, "anchors")
    again = skew_join(parts.drop("digest"), ["anchor"], counts.select("anchor", "alike"), counts, "often", "at")
    wanted = again.groupBy(ROW).agg(F.collect_list(F.struct("at", "n", "alike")).alias("parts"))
    schema = f"{ROW} long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, kept_sha256 string, words binary, parts array<struct<at:int,n:int,alike:boolean>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = list(map(plain_words, byte_texts(batch.column("text"))))
            parts = batch.column("parts")
            numbers = [w.count(b" ") + 1 if w else 0 for w in whole]
            kept = [w if k else None for w, k in zip(whole, parts.is_valid().to_pylist())]
            digests = [hashlib.sha256(w).hexdigest() for w in whole]
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), batch.column("doc_id"), pa.array(numbers, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary()), parts],
                names=[ROW, "doc_id", "n_words", "kept_sha256", "words", "parts"],
            )

    return durable(rows.join(wanted, ROW, "left").select(ROW, "doc_id", "text", "parts").mapInArrow(run, schema), "suspects")


def _window_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """128-bit digest of each window of the segments, with the words before and after it (0: none).

    Where all segments of an anchor are alike, its windows always occur together and are one row.
    """
    digest, word = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest
    for batch in (part for whole in batches for part in slices(whole, "words", _TEXTS)):
        texts, parts = batch.column("words").to_pylist(), batch.column("parts")
        if not texts:
            continue
        # the texts of a part are one run of words, and base the place of each text's first word in it
        data = b" ".join(texts)
        spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        starts, ends = np.r_[0, spaces + 1], np.r_[spaces, len(data)]
        base = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        flat = parts.flatten()
        first, n = (flat.field(k).to_numpy().astype(np.int64) for k in ("at", "n"))
        alike = flat.field("alike").to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy())
        n, times = np.where(alike, n, 1), np.where(alike, 1, n)
        at, n, of = ranges(first, times), np.repeat(n, times), np.repeat(of, times)
        head = at + base[of]
        last = head + n + window - 2
        sums = b"".join([digest(data[s:e]) for s, e in zip(starts[head].tolist(), ends[last].tolist())])
        sums = np.frombuffer(sums, "<i8").reshape(-1, 2)
        has_before, has_after = at > 0, last + 1 < base[of + 1]
        hashes = np.zeros(len(starts) + 1, np.uint64)
        hashes[head[has_before] - 1] = hashes[last[has_after] + 1] = 1
        asked = np.flatnonzero(hashes)
        told = (word(data[s:e]) for s, e in zip(starts[asked].tolist(), ends[asked].tolist()))
        hashes[asked] = np.fromiter(told, np.uint64, len(asked)) | np.uint64(1)
        before, after = np.where(has_before, hashes[head - 1], 0), np.where(has_after, hashes[last + 1], 0)
        taken = pa.array(of)
        columns = [sums[:, 0].copy(), sums[:, 1].copy(), batch.column(ROW).take(taken), batch.column("doc_id").take(taken), at.astype(np.int32), n.astype(np.int32), before.astype(np.uint64).view(np.int64), after.astype(np.uint64).view(np.int64)]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["d1", "d2", ROW, "doc_id", "at", "n", "before", "after"])


def _chains(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Passages of a text from the recurring windows that are first in it.

    Windows that follow each other at each of their places make one passage: the first has one word after it
    everywhere, the second one word before it everywhere. A passage thus recurs as a whole or not at all.
    """
    for batch in batches:
        out = []
        for row, text, firsts in zip(batch.column(ROW).to_pylist(), batch.column("words").to_pylist(), batch.column("firsts").to_pylist()):
            words, chain = text.split(), []

            def cut() -> None:
                head, n = chain[0], chain[-1]["at"] + chain[-1]["n"] - chain[0]["at"] + window - 1
                out.append((row, head["at"], n, b" ".join(words[head["at"] : head["at"] + n]), head["d1"], head["d2"]))

            for w in sorted(firsts, key=lambda w: w["at"]):
                if chain and not (w["at"] == chain[-1]["at"] + chain[-1]["n"] and chain[-1]["one_after"] and w["one_before"]):
                    cut()
                    chain.clear()
                chain.append(w)
            cut()
        columns = list(zip(*out)) or [()] * 6
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[ROW, "at", "n", "words", "d1", "d2"])


class PassageAutomaton:
    """Aho-Corasick automaton over the words of passages."""

    def __init__(self, passages: list[tuple[bytes, tuple[int, int]]]):
        self.ids: dict[bytes, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for text, first in passages:
            words = text.split()
            for w in words:
                self.ids.setdefault(w, len(self.ids) + 1)
            self.machine.add_word(tuple(map(self.ids.__getitem__, words)), (len(words), first))
        self.machine.make_automaton()

    def places(self, text: bytes) -> Iterator[tuple[int, int, tuple[int, int]]]:
        """First word, number of words and first place of every occurrence of every passage, overlapping ones included."""
        for end, (n, first) in self.machine.iter(tuple(map(self.ids.get, text.split(), repeat(0)))):
            yield end - n + 1, n, first


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences in documents that follow the passages of their shard and block, but for the first of each passage."""
    key, passages, machine = None, [], None
    for batch in batches:
        out = []
        for shard, block, document, row, at, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "document", ROW, "at", "words"))):
            if (shard, block) != key:
                key, passages, machine = (shard, block), [], None
            if not document:
                passages.append((words, (row, at)))
                continue
            machine = machine or PassageAutomaton(passages)
            out += [(row, start, n) for start, n, first in machine.places(words) if first != (row, start)]
        columns = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32()))], names=[ROW, "at", "n"])


def later_places(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """ROW, first word and number of words of every passage that also starts earlier; ``docs`` as of ``suspects``.

    Documents go to the automata of the passages whose first window they hold. A shard with many documents is cut into blocks,
    each with its own copy of the automaton.
    """
    some, key = docs.where("words is not null"), ["d1", "d2"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    windows = some.select(ROW, "doc_id", "words", "parts").mapInArrow(lambda b: _window_rows(b, window), f"d1 long, d2 long, {ROW} long, doc_id {kind}, at int, n int, before long, after long")
    windows = durable(windows, "windows")
    first = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"), "at")
    one = [((F.min(c) == F.max(c)) & (F.min(c) != 0)).alias(f"one_{c}") for c in ("before", "after")]
    groups = windows.groupBy(*key).agg(F.count("*").alias("often"), F.min(first).alias("first"), F.first("n").alias("n"), *one).where("often > 1")
    groups = durable(groups.select(*key, "often", F.col("first.row").alias(ROW), F.col("first.at").alias("at"), "n", "one_before", "one_after"), "recurring")
    firsts = groups.groupBy(ROW).agg(F.collect_list(F.struct("at", "n", *key, "one_before", "one_after")).alias("firsts"))
    passages = some.select(ROW, "words").join(firsts, ROW).mapInArrow(lambda b: _chains(b, window), f"{ROW} long, at int, n int, words binary, d1 long, d2 long")
    passages = durable(passages, "passages")
    shards = max(1, (passages.agg(F.sum("n")).first()[0] or 0) // shard_words)
    passages = passages.withColumn("shard", F.pmod(F.xxhash64(ROW, F.floor(F.col("at") / shard_words)), F.lit(shards)))
    routes = durable(skew_join(windows.select(*key, ROW, "at"), key, passages.select(*key, "shard"), groups, "often", "at").select(ROW, "shard").distinct(), "routes")
    blocks = durable(routes.groupBy("shard").agg(F.count("*").alias("documents")).withColumn("blocks", F.ceil(F.col("documents") / block_docs).cast("int")), "blocks")
    routed = skew_join(routes, ["shard"], blocks.select("shard", "blocks"), blocks, "documents", ROW)
    routed = routed.withColumn("block", F.pmod(F.xxhash64(ROW), F.col("blocks")).cast("int")).groupBy(ROW).agg(F.collect_list(F.struct("shard", "block")).alias("to"))
    readers = some.select(ROW, "words").join(routed, ROW).withColumn("to", F.explode("to")).select("to.shard", "to.block", F.lit(True).alias("document"), ROW, F.lit(0).alias("at"), "words")
    machines = passages.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    told = machines.select("shard", "block", F.lit(False).alias("document"), ROW, "at", "words").unionByName(readers)
    laid = told.repartition("shard", "block").sortWithinPartitions("shard", "block", "document")
    return laid.mapInArrow(_locate, f"{ROW} long, at int, n int")


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words removed, words left and their digest; texts without words here keep what was found before."""
    for batch in batches:
        removed, digests, left = [], [], []
        for digest, text, places in zip(batch.column("kept_sha256").to_pylist(), batch.column("words").to_pylist(), batch.column("places").to_pylist()):
            if not places:
                removed.append(0)
                digests.append(digest)
                left.append(None)
                continue
            words = text.split()
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, [p["at"] for p in places], 1)
            np.add.at(edge, [p["at"] + p["n"] for p in places], -1)
            stay = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
            kept = b" ".join([words[i] for i in stay.tolist()])
            removed.append(len(words) - len(stay))
            digests.append(hashlib.sha256(kept).hexdigest())
            left.append(kept)
        columns = [batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(left, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Each document without the words of windows that also start earlier.

    Returns doc_id, n_words, n_removed, kept_sha256 and kept, the words left of texts that lost some (null for others, which
    keep all their words). A window is ``window`` consecutive words of one document; earlier is at a smaller doc_id
    (null after all others; of repeated ids the row read first) or before in the same document. The input decides,
    not what is left. Null and empty texts have no words; an empty table gives an empty result.
    """
    rows = numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    found = suspects(rows, window)
    places = later_places(found, window, shard_words, block_docs).groupBy(ROW).agg(F.collect_list(F.struct("at", "n")).alias("places"))
    whole = found.drop("parts").join(places, ROW, "left").select("doc_id", "n_words", "kept_sha256", "words", "places")
    return whole.mapInArrow(_left, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string, kept binary")
