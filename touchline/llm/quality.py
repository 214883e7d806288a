"""Quality of documents by attention-based multiple-instance learning over their passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import flat_bytes, ranges, slices
from touchline.llm.language import fold

#: bytes of a passage
PASSAGE = 512
#: labelled documents that the weights are fitted on, and passages of all of them together; documents are taken whole
SAMPLE = 4000
SAMPLE_PASSAGES = 100_000
ENCODED = 24
ATTENTION = 12
EPOCHS = 30
THRESHOLD = 0.3
_SIGNS = ".,|!?#$%&*:;-/\"'()"
CLASSES = 7 + len(_SIGNS)


def _classes() -> np.ndarray:
    """Class of every byte: lower, upper, digit, blank, line end, beyond ASCII, other, and some signs each."""
    table = np.full(256, 6)
    table[97:123], table[65:91], table[48:58], table[128:] = 0, 1, 2, 5
    table[[32, 9]], table[[10, 13]] = 3, 4
    for i, sign in enumerate(_SIGNS):
        table[ord(sign)] = 7 + i
    return table


#: distances in bytes at which repetition is looked for, about the lengths of words with their blank
BACK = range(3, 25)
FEATURES = CLASSES * CLASSES + 1


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and the number of passages of each text (at least one).

    Features are the shares of neighbouring class pairs, and the largest share of bytes that equal the byte at one
    fixed distance before, which is high where words repeat.
    """
    sizes = np.diff(offsets)
    number = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(np.r_[0, number[:-1]])
    owner = np.repeat(first, sizes) + (np.arange(len(data)) - np.repeat(offsets[:-1], sizes)) // PASSAGE
    total = int(number.sum())
    kind = _classes()[data]
    pair = kind[:-1] * CLASSES + kind[1:]
    same = owner[:-1] == owner[1:]
    counts = np.bincount((owner[:-1] * FEATURES + pair)[same], minlength=total * FEATURES).reshape(total, FEATURES).astype(np.float32)
    length = np.maximum(1, np.bincount(owner, minlength=total)).astype(np.float32)
    begins = np.flatnonzero(np.r_[True, ~same])[: len(data)]
    filled = owner[begins]
    most = np.zeros(total)
    for back in BACK:
        if len(data) > back:
            hit = np.zeros(len(data), np.int32)
            hit[back:] = data[back:] == data[:-back]
            most[filled] = np.maximum(most[filled], np.add.reduceat(hit, begins))
    counts[:, CLASSES * CLASSES] = most
    return np.sqrt(counts / length[:, None]), number


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Bags:
    """Weights: passages x -> tanh(xE) = h; attention a of softmax(w(tanh(hV) * sigmoid(hU))); score of sum(a h)."""

    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, number: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        starts = np.cumsum(np.r_[0, number[:-1]])
        h = np.tanh(x @ w["E"] + w["e"])
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        raw = (t * s) @ w["w"]
        raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), number))
        a = raw / np.repeat(np.add.reduceat(raw, starts), number)
        z = np.add.reduceat(h * a[:, None], starts, axis=0)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ w["o"] + w["c"])}

    def gradients(self, x: np.ndarray, number: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        w, f = self.weights, self.forward(x, number)
        starts = np.cumsum(np.r_[0, number[:-1]])
        d = (f["p"] - y) / len(y)
        dz = np.repeat(d[:, None] * w["o"], number, axis=0)
        da = np.einsum("ij,ij->i", dz, f["h"])
        draw = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), number))
        dgate = draw[:, None] * w["w"]
        dt, ds = dgate * f["s"] * (1 - f["t"] ** 2), dgate * f["t"] * f["s"] * (1 - f["s"])
        dh = dz * f["a"][:, None] + dt @ w["V"].T + ds @ w["U"].T
        dh *= 1 - f["h"] ** 2
        return {
            "E": x.T @ dh, "e": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds,
            "w": (f["t"] * f["s"]).T @ draw, "o": f["z"].T @ d, "c": np.array(d.sum()),
        }


def fit(x: np.ndarray, number: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Bags:
    """Weights by Adam over batches of documents, in a fixed order of draws. Without rows the score is 0.5."""
    rng = np.random.default_rng(seed)
    shapes = {"E": (FEATURES, ENCODED), "e": (ENCODED,), "V": (ENCODED, ATTENTION), "U": (ENCODED, ATTENTION), "w": (ATTENTION,), "o": (ENCODED,), "c": ()}
    weights = {k: rng.normal(0, 1 / np.sqrt(max(1, s[0] if len(s) == 2 else 12)), s) if k not in "ec" else np.zeros(s) for k, s in shapes.items()}
    bags = Bags(weights)
    if not len(y):
        weights["o"] = np.zeros(ENCODED)
        return bags
    starts = np.cumsum(np.r_[0, number[:-1]])
    m, v = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 128):
            some = order[at : at + 128]
            rows = ranges(starts[some], number[some])
            g = bags.gradients(x[rows].astype(np.float64), number[some], y[some])
            step += 1
            for k in shapes:
                grad = g[k] + 1e-4 * weights[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad**2
                weights[k] = weights[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Bags(weights)


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_passages: int = SAMPLE_PASSAGES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All passages of at most ``most`` labelled documents that are not held out: features, passages of each, label.

    The documents are those with the smallest hashes of their ids, as many as hold at most ``most_passages`` passages together.
    Labels of one id that differ are averaged.
    """
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    size = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / PASSAGE))
    # at most `most` rows
    sizes = docs.select("doc_id", size.alias("n")).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.sum("n").alias("n"), F.first("quality").alias("quality"))
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    chosen = sizes.withColumn("_sum", F.sum("n").over(upto)).where(F.col("_sum") <= most_passages).select("doc_id", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                x, number = passages(*flat_bytes(part.column("text")))
                ends = np.cumsum(number)
                packed = [np.round(x[e - n : e] * 255).astype(np.uint8).tobytes() for e, n in zip(ends, number)]
                yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array(number, pa.int32()), pa.array(packed, pa.binary())], names=["quality", "passages", "features"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality").mapInArrow(run, "quality int, passages int, features binary").collect()
    rows.sort(key=lambda r: (r["features"], r["quality"]))
    x = np.frombuffer(b"".join(r["features"] for r in rows), np.uint8).reshape(-1, FEATURES).astype(np.float32) / 255
    return x, np.array([r["passages"] for r in rows], np.int64), np.array([r["quality"] for r in rows], np.float64)


def score(docs: DataFrame, model: Bags, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` in place of the text. A null or empty text is one passage of nothing."""
    rest = [c for c in docs.columns if c not in (text, "score")]
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                x, number = passages(*flat_bytes(part.column(text)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(model.forward(x, number)["p"].astype(np.float64))], names=[*rest, "score"])

    return docs.select(*rest, text).mapInArrow(run, f"{fields}score double")


def rate(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Weights are fitted on at most ``most`` whole labelled documents outside the held-out fold; every
    passage of every document is scored. Null and empty texts are scored too; repeated rows get equal scores; labels
    of unknown documents and null labels are ignored; empty tables give an empty result or, without
    labels, the score 0.5.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model = fit(*sample(rows, labels, most))
    scored = score(rows.withColumn("held_out", fold(F.col("doc_id"), 5) == 0), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
