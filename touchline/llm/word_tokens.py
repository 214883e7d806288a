"""Token ids of whole texts with a word-level byte-pair model, each distinct word encoded once per process."""

from __future__ import annotations

from array import array

import numpy as np
import regex
from tokenizers import Tokenizer

from touchline.llm.common import kept

#: fixed value: how the model cuts words
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: characters that normalisation only lowers
_PLAIN = r"[\n!-~À-ÖØ-öø-ÿ]*"
_MOST_WORDS = 400_000


def _byte_signs() -> dict[int, str]:
    """The printable sign of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordCoder:
    """Ids of texts exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Tokens never reach over white space, so a text is cut at ASCII white space and each distinct piece is
    encoded once. Pieces of plain letters and signs are cut into words here and merged by the tokenizer's own
    model; all others go through the tokenizer whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = regex.compile(WORDS + r"|\n")
        self.plain = regex.compile(_PLAIN)
        self.signs = _byte_signs()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks: dict[bytes, bytes] = {}
        self.known: dict[str, bytes] = {}
        for probe in ("The cat's 12 Ünïcode, (word)!! don't <a|b> x_y", "ÀÉ ß ñ"):
            if self.encode(probe.encode()) != self._whole(probe):
                raise ValueError("the tokenizer cuts words in another way")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        signs = word.encode().decode("latin-1").translate(self.signs)
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def _plain(self, text: str) -> bool:
        return self.plain.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _learn(self, fresh: list[bytes]) -> None:
        """Put the ids of these pieces into ``chunks``, all their words cut out in one pass."""
        text = b"\n".join(fresh).decode()
        if not self._plain(text):
            for c in [c for c in fresh if not self._plain(c.decode())]:
                self.chunks[c] = self._whole(c.decode())
            fresh = [c for c in fresh if c not in self.chunks]
            text = b"\n".join(fresh).decode()
        words = self.words.findall(text.lower() + "\n")
        if len(self.known) > _MOST_WORDS:
            self.known.clear()
        for w in set(words).difference(self.known, "\n"):
            self.known[w] = self._word(w)
        coded = list(map(self.known.get, words))
        start = 0
        for c, end in zip(fresh, [i for i, w in enumerate(words) if w == "\n"]):
            self.chunks[c] = b"".join(coded[start:end])
            start = end + 1

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        chunks = text.split()
        if len(self.chunks) > _MOST_WORDS:
            self.chunks.clear()
        fresh = set(chunks).difference(self.chunks)
        if fresh:
            self._learn(list(fresh))
        return b"".join(map(self.chunks.__getitem__, chunks))


def coder(path: str) -> WordCoder:
    return kept(f"words {path}", lambda: WordCoder(path))
