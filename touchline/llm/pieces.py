"""Byte-pair encoding and decoding with a SentencePiece model, in vectorised merge rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from touchline.llm.common import byte_texts, kept, slices

SPACE = "▁"
#: words that a process remembers, about 200 bytes each
_MOST_WORDS = 700_000
#: a text that normalisation would change
_PROBE = "a  b \ufb01 \uff21 e\u0301"
_NONE = np.int64(1 << 40)


class PieceModel:
    """Vocabulary of a model without text normalisation, as arrays.

    Symbols are numbered: pieces by their id, other characters from the size of the vocabulary up.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.decode(model.encode(_PROBE)) != _PROBE:
            raise ValueError("models that rewrite text are not supported")
        n = model.get_piece_size()
        self.size = n
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if any(a != SPACE and b == SPACE for i in plain for a, b in zip(names[i], names[i][1:])):
            raise ValueError("pieces reach over the start of a word")
        self.ids = {names[i]: i for i in plain}
        self.score = {i: model.get_score(i) for i in plain}
        # rank: place in descending order of score
        order = sorted(set(self.score.values()), reverse=True)
        place = {s: r for r, s in enumerate(order)}
        left, right, rank, made = [], [], [], []
        for name, i in self.ids.items():
            for cut in range(1, len(name)):
                a, b = self.ids.get(name[:cut]), self.ids.get(name[cut:])
                # a character outside the vocabulary of pieces cannot be part of a longer piece
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(place[self.score[i]]), made.append(i)
        self._index(np.array(left, np.int64) * n + np.array(right, np.int64), np.array(rank, np.int64), np.array(made, np.int64))
        missing = {c for name in self.ids for c in name} - set(self.ids)
        if missing:
            raise ValueError(f"characters of pieces are no pieces themselves: {sorted(missing)[:5]}")
        # symbol of each code point; those that are no piece follow the vocabulary
        self.symbol = np.arange(n, n + 0x110000)
        single = {name: i for name, i in self.ids.items() if len(name) == 1}
        self.symbol[[ord(c) for c in single]] = list(single.values())
        self.cut_lines = all("\n" not in name for name in self.ids if len(name) > 1)
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = model.unk_id()
        self.surface = [b""] * n
        for i in plain:
            self.surface[i] = names[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            if i != self.unknown:
                self.surface[i] = bytes([b])
        self.surface[self.unknown] = " ⁇ ".encode()
        self.is_byte = np.zeros(n, bool)
        self.is_byte[[i for i in self.byte if i != self.unknown]] = True
        self.words: dict[str, bytes] = {}

    def _index(self, pair: np.ndarray, rank: np.ndarray, made: np.ndarray) -> None:
        """Open hashing of pairs, four slots for each."""
        self.bits = max(4, (4 * len(pair)).bit_length())
        self.slot_pair = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank, self.slot_made = np.full(1 << self.bits, _NONE), np.zeros(1 << self.bits, np.int64)
        left, at = np.arange(len(pair)), self._slot(pair)
        while len(left):
            # of several pairs that want a free slot the last one written has it
            free = self.slot_pair[at] < 0
            self.slot_pair[at[free]] = pair[left[free]]
            placed = self.slot_pair[at] == pair[left]
            self.slot_rank[at[placed]], self.slot_made[at[placed]] = rank[left[placed]], made[left[placed]]
            left, at = left[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of pairs; the rank is ``_NONE`` where no piece is spelled so."""
        key = np.where((left < self.size) & (right < self.size), left * self.size + right, -2)
        at = self._slot(key)
        held = self.slot_pair[at]
        more = np.flatnonzero((held != key) & (held >= 0))
        while len(more):
            at[more] = (at[more] + 1) & ((1 << self.bits) - 1)
            held = self.slot_pair[at[more]]
            more = more[(held != key[more]) & (held >= 0)]
        hit = self.slot_pair[at] == key
        return np.where(hit, self.slot_rank[at], _NONE), self.slot_made[at]

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all words of a flat symbol array until no pair of neighbours is a piece.

        Each round finds the smallest pair rank of every word and merges its leftmost occurrence; further
        occurrences in the word are merged in the same round where no pair that comes into being
        on the way ranks as high, so that the result is that of one merge at a time. Words without
        such a pair leave, and the arrays are compacted.
        """
        done_s, done_w = [], []
        rank, made = self._lookup(symbols, np.r_[symbols[1:], 0])
        rank[np.r_[word[1:] != word[:-1], True]] = _NONE  # the pair that would leave the word
        while len(symbols):
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[heads, len(symbols)])
            best = np.minimum.reduceat(rank, heads)
            if (best == _NONE).any():
                live = np.repeat(best < _NONE, sizes)
                done_s.append(symbols[~live])
                done_w.append(word[~live])
                symbols, word, rank, made = symbols[live], word[live], rank[live], made[live]
                best, sizes = best[best < _NONE], sizes[best < _NONE]
            goal = np.repeat(best, sizes)
            hit = np.flatnonzero(rank == goal)
            # of overlapping pairs every second one, from the left
            first = np.flatnonzero(np.r_[True, np.diff(hit) != 1])[: len(hit)]
            hit = hit[(np.arange(len(hit)) - np.repeat(first, np.diff(np.r_[first, len(hit)]))) % 2 == 0]
            leftmost = np.r_[True, word[hit[1:]] != word[hit[:-1]]][: len(hit)]
            if not leftmost.all():
                hit = hit[leftmost | self._safe(symbols, word, goal, made, hit)]
            symbols[hit] = made[hit]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            at = (np.cumsum(stay) - 1)[hit]
            symbols, word, rank, made = symbols[stay], word[stay], rank[stay], made[stay]
            at = np.r_[at, np.maximum(at - 1, 0)]
            after = np.minimum(at + 1, len(symbols) - 1)
            rank[at], made[at] = self._lookup(symbols[at], symbols[after])
            rank[at[(after == at) | (word[after] != word[at])]] = _NONE
        none = np.zeros(0, np.int64)
        symbols, word = np.concatenate([none, *done_s]), np.concatenate([none, *done_w])
        by = np.argsort(word, kind="stable")
        return symbols[by], word[by]

    def _safe(self, symbols, word, goal, made, hit) -> np.ndarray:
        """Whether all hits of a word may be merged at once: no pair with a merged symbol ranks as high.

        Merging from the left, a new symbol meets what is before it after, and what is behind it before and
        after its own merge.
        """
        new = symbols.copy()
        new[hit] = made[hit]
        gone = np.zeros(len(symbols), bool)
        gone[hit + 1] = True
        last = len(symbols) - 1
        behind, before = np.minimum(hit + 2, last), np.maximum(hit - 1, 0)
        has_behind = (hit + 2 <= last) & (word[behind] == word[hit])
        has_before = (hit > 0) & (word[before] == word[hit])
        before = np.where(gone[before], np.maximum(before - 1, 0), before)
        bad = np.zeros(len(hit), bool)
        for has, left, right in (
            (has_behind, made[hit], symbols[behind]),
            (has_behind, made[hit], new[behind]),
            (has_before, new[before], made[hit]),
        ):
            bad |= has & (self._lookup(left, right)[0] <= goal[hit])
        return ~np.isin(word[hit], np.unique(word[hit[bad]]))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words, none of which a piece reaches over, as 32-bit integers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols, word = self.merge(self.symbol[points], np.repeat(np.arange(len(words)), sizes))
        ends = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        other = np.add.reduceat(np.r_[symbols >= self.size, False], ends[:-1]) if len(words) else []
        flat = symbols.astype("<i4").tobytes()
        return [
            flat[4 * a : 4 * b] if not odd else np.array(list(self._spelled(symbols[a:b].tolist())), "<i4").tobytes()
            for a, b, odd in zip(ends, ends[1:], other)
        ]

    def _spelled(self, symbols: list[int]) -> Iterator[int]:
        for s in symbols:
            if s < self.size:
                yield s
            elif self.byte[0] != self.unknown:
                yield from (self.byte[b] for b in chr(s - self.size).encode())
            else:
                yield self.unknown

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, without begin or end."""
        if len(self.words) > _MOST_WORDS:
            self.words.clear()
        split = [self._words(text) for text in texts]
        todo = list({w for words in split for w in set(words).difference(self.words)})
        for at in range(0, len(todo), 20_000):
            part = todo[at : at + 20_000]
            self.words.update(zip(part, self.encode_words(part)))
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), "<i4") for words in split]

    def _words(self, text: str) -> list[str]:
        """A space sign in front of the text, cut before each run of signs, and around line ends if pieces allow."""
        if not text:
            return []
        words: list[str] = []
        text = text.replace(SPACE, " ")
        for i, line in enumerate(text.split("\n") if self.cut_lines else [text]):
            if i:
                words.append("\n")
            parts = line.split(" ")
            if i:
                if parts[0]:
                    words.append(parts[0])
                del parts[0]
            if all(parts):
                words += [SPACE + p for p in parts]
                continue
            signs = 0
            for p in parts:
                signs += 1
                if p:
                    words.append(SPACE * signs + p)
                    signs = 0
            if signs:
                words.append(SPACE * signs)
        return words

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: the pieces' text, bytes where pieces are bytes, and without the sign in front."""
        out = b"".join(map(self.surface.__getitem__, ids.tolist()))
        if out[:1] == b" " and not self.is_byte[ids[0]]:
            out = out[1:]
        return out.decode("utf-8", "replace")


def encode_decode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` in place of the text.

    Null text counts as empty and has no ids. Other columns stay as they are, except that columns named ``ids`` or
    ``decoded`` are replaced; repeated rows are encoded alike; an empty table gives an empty result. Words are
    encoded once per process while they are remembered, so memory does not grow with the table.
    """
    rest = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    schema = f"{fields}{', ' if rest else ''}ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept(f"pieces {model_path}", lambda: PieceModel(model_path))
        for batch in batches:
            for part in slices(batch, text, 2 << 20):
                found = model.encode([t.decode() for t in byte_texts(part.column(text))])
                ends = np.cumsum([0, *map(len, found)])
                flat = np.concatenate([np.zeros(0, np.int32), *found])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                decoded = pa.array([model.decode(i) if len(i) else "" for i in found], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), ids, decoded], names=[*rest, "ids", "decoded"])

    return docs.select(*rest, text).mapInArrow(run, schema)
