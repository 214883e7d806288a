"""Languages of a text as a mixture: proportions by expectation-maximisation, the set by penalised likelihood."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import byte_texts, forget, ranges, slices

BUCKETS = 1 << 13
#: rounds between two looks at how far the proportions may still rise, and how far they may when they count as settled, in nats
ROUNDS = 12
SETTLED = 0.05
#: nats that each language after the first costs, times the log of the number of n-grams
PENALTY = 3.0
UNKNOWN = "und"
_LETTER = r"[^\W\d_]"


def _folding() -> np.ndarray:
    """Bytes with ASCII letters in lower case and everything else below 128 as space."""
    table = np.arange(256)
    table[:128] = 32
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    return table.astype(np.int64)


def grams(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, bucket and count of the byte trigrams of every text, by text. Each text has a space around it."""
    flat = np.frombuffer(b"".join(b" " + t + b" " for t in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    b = _folding()[flat]
    # capital letters of the first two-byte block, as in western languages
    b[1:][(flat[:-1] == 0xC3) & (flat[1:] < 0x9F)] |= 0x20
    if len(b) < 3:
        none = np.zeros(0, np.int64)
        return none, none, none
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    bucket = ((code * 0x9E3779B1) & 0xFFFFFFFF) >> 16 & (buckets - 1)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = (owner[:-2] == owner[2:]) & ((b[:-2] != 32) | (b[1:-1] != 32))
    key = np.sort((owner[:-2] * buckets + bucket)[inside])
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[: len(key)]
    return key[heads] // buckets, key[heads] % buckets, np.diff(np.r_[heads, len(key)])


@dataclass
class Mixture:
    """Names of the languages, and the probability of each bucket (rows) in each (columns)."""

    names: list[str]
    share: np.ndarray


def _sums(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, heads, axis=0)


class _Counts:
    """n-grams of some texts: probability in each language, count, and where each text begins."""

    def __init__(self, p: np.ndarray, count: np.ndarray, heads: np.ndarray):
        self.p, self.count, self.heads = p, count, heads
        self.sizes = np.diff(np.r_[heads, len(count)])
        self.total = _sums(count, heads).astype(np.float64)

    def of(self, texts: np.ndarray) -> _Counts:
        if len(texts) == len(self.heads):
            return self
        rows = ranges(self.heads[texts], self.sizes[texts])
        return _Counts(self.p[rows], self.count[rows], np.r_[0, np.cumsum(self.sizes[texts])[:-1]])

    def rounds(self, mix: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``n`` rounds of expectation-maximisation: proportions, log-likelihood, and a bound of what more rounds can add.

        The likelihood is concave in the proportions, so it lies below its tangent: no proportions of the same languages reach
        more than the largest slope less the number of n-grams above it.
        """
        for step in range(n + 1):
            mean = np.einsum("ij,ij->i", np.repeat(mix, self.sizes, axis=0), self.p)
            slope = _sums(self.p * (self.count / mean)[:, None], self.heads)
            if step < n:
                mix = mix * slope / self.total[:, None]
        likely = _sums(self.count * np.log(mean), self.heads)
        return mix, likely, np.where(mix > 0, slope, 0).max(axis=1) - self.total

    def settle(self, mix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihood once no text can gain more than ``SETTLED``; languages at 0 stay out."""
        mix, likely, active = mix.copy(), np.zeros(len(mix)), np.arange(len(mix))
        while len(active):
            mix[active], likely[active], more = self.of(active).rounds(mix[active], ROUNDS)
            active = active[more > SETTLED]
        return mix, likely


def _sets(counts: _Counts, chosen: np.ndarray, cost: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Largest language of the best set of each text, from the single language ``chosen`` with log-likelihood ``value``.

    One language is added or dropped, whichever raises the penalised likelihood most, until none does. A set costs
    ``cost`` for each language after the first.
    """
    n, languages = len(chosen), counts.p.shape[1]
    held = np.zeros((n, languages), bool)
    held[np.arange(n), chosen] = True
    pick, value, active = chosen.copy(), value.copy(), np.arange(n)
    while len(active):
        some = counts.of(active)
        best, toggle, largest = value[active].copy(), np.full(len(active), -1), np.zeros(len(active), np.int64)
        for j in range(languages):
            tried = held[active].copy()
            tried[:, j] ^= True
            able = np.flatnonzero(tried.any(axis=1))
            if not len(able):
                continue
            start = tried[able] / tried[able].sum(axis=1, keepdims=True)
            mix, likely = some.of(able).settle(start)
            worth = likely - (tried[able].sum(axis=1) - 1) * cost[active[able]]
            up = worth > best[able] + 1e-9
            best[able[up]], toggle[able[up]], largest[able[up]] = worth[up], j, mix[up].argmax(axis=1)
        moved = toggle >= 0
        active, toggle = active[moved], toggle[moved]
        held[active, toggle] ^= True
        value[active], pick[active] = best[moved], largest[moved]
    return pick


def proportions(model: Mixture, texts: list[bytes], penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Most likely language and its proportion in each text; language -1 where there is nothing to go by."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    doc, bucket, count = grams(texts, len(model.share))
    if not len(doc) or not model.names:
        return best, score
    heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    which = doc[heads]
    counts = _Counts(model.share[bucket], count, heads)
    alone = _sums(count[:, None] * np.log(counts.p), heads)
    chosen, gain = alone.argmax(axis=1), alone.max(axis=1)
    cost = penalty * np.log(counts.total + 1)
    mix, reached, more = counts.rounds(np.full(alone.shape, 1 / len(model.names)), ROUNDS)
    # no set beats the one language if even the bound for all languages together gains less than a second one costs
    open_ = np.flatnonzero(reached + more - cost > gain)
    undecided = open_[more[open_] > SETTLED]
    while len(undecided):
        mix[undecided], reached[undecided], more[undecided] = counts.of(undecided).rounds(mix[undecided], ROUNDS)
        undecided = undecided[(more[undecided] > SETTLED) & ((reached + more - cost > gain)[undecided])]
    open_ = open_[(reached + more - cost > gain)[open_]]
    pick = chosen.copy()
    if len(open_):
        pick[open_] = _sets(counts.of(open_), chosen[open_], cost[open_], gain[open_])
    best[which] = pick
    score[which] = np.clip(mix[np.arange(len(heads)), pick], 0.0, 1.0)
    return best, score


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS, smoothing: float = 0.5) -> Mixture:
    """n-gram shares of every language of all rows with a text and a language.

    Each task adds up its rows and hands on one row per language and bucket; the model has languages x
    ``buckets`` numbers, however many rows there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        forget()
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                doc, bucket, count = grams(byte_texts(part.column(text)), buckets)
                names = np.array(part.column(lang).to_pylist(), object)
                for name in set(names):
                    of = (names == name)[doc]
                    held = sums.setdefault(name, np.zeros(buckets))
                    held += np.bincount(bucket[of], count[of], minlength=buckets)
        for name, held in sums.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(held[at].astype(np.int64))], names=["lang", "bucket", "n"])

    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, lang)
    rows = labelled.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    names = sorted({r["lang"] for r in rows})
    counts = np.full((buckets, len(names)), smoothing)
    place = {n: i for i, n in enumerate(names)}
    for r in rows:
        counts[r["bucket"], place[r["lang"]]] += r["n"]
    return Mixture(names, counts / counts.sum(axis=0, keepdims=True) if names else counts)


def predict(docs: DataFrame, model: Mixture, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of these names are replaced).

    A null text, or one without a letter, is ``und`` with score 0, and so is any text if nothing was
    learned. Repeated rows get equal results; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = re.compile(_LETTER)
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                texts = byte_texts(part.column(text))
                best, score = proportions(model, texts)
                known = np.array([letter.search(t.decode()) is not None for t in texts], bool) & (best >= 0)
                names = [model.names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], names=[*kept, "lang_pred", "score"]
                )

    return docs.select(*kept).mapInArrow(run, f"{fields}, lang_pred string, score double")


def fold(doc_id: Column, folds: int) -> Column:
    """Remainder that decides whether a document is held out; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those not held out."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    model = learn(rows.where(~F.col("held_out")))
    return predict(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def drop_unknown(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without documents whose language cannot be told (null text, or no letter)."""
    model = learn(docs.where(fold(F.col(doc_id), 3) != 1), text, lang)
    hidden = {"lang_pred": "_lang_pred", "score": "_score"}
    told = predict(docs.withColumnsRenamed(hidden), model, text).where(F.col("lang_pred") != UNKNOWN)
    return told.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in hidden.items()}).select(*docs.columns)
