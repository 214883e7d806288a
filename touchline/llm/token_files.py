"""Token ids as flat unsigned integers with 64-bit offsets, in files that are read through memory maps."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import ROW, byte_texts, numbered, slices
from touchline.llm.word_tokens import coder
from touchline.session import scratch_path

END = 2
_MANIFEST = "part int, name string, documents long, tokens long, nulls long"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end: int = END, wide: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all texts in ascending doc_id order and return the manifest, a row per written part.

    A part has three files: ``.bin`` with ids as unsigned 16-bit integers (32-bit if ``wide``), ``.idx`` with the
    64-bit offsets of its documents, and ``.ids`` with their doc_ids. A null doc_id comes first and is held as 0
    (the manifest counts them); rows with equal ids follow in reading order. Null text counts as empty. A
    task that runs again writes under a new name; only files named in the manifest count.
    """
    spark = docs.sparkSession
    kind = "<u4" if wide else "<u2"
    rows = numbered(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    ordered = rows.repartitionByRange("doc_id", ROW).sortWithinPartitions("doc_id", ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        words, last = coder(tokenizer_path), np.array([end], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        name = f"{part:05d}-{uuid.uuid4().hex}"
        sizes, ids, nulls, out = [np.zeros(1, np.int64)], [], 0, None
        for batch in batches:
            for some in slices(batch, "text", 4 << 20):
                if out is None:
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{name}.bin")
                coded = [words.encode(raw) + last for raw in byte_texts(some.column("text"))]
                flat = np.frombuffer(b"".join(coded), "<u4")
                if not wide and flat.max(initial=0) > 0xFFFF:
                    raise ValueError("ids need 32 bits")
                out.write(flat.astype(kind).tobytes())
                sizes.append(np.fromiter(map(len, coded), np.int64, len(coded)) // 4)
                nulls += some.column("doc_id").null_count
                ids.append(some.column("doc_id").fill_null(0).to_numpy())
        if out is None:
            return
        out.close()
        offsets = np.cumsum(np.concatenate(sizes))
        for ending, data in (("idx", offsets), ("ids", np.concatenate(ids))):
            with system.open_output_stream(f"{path}/{name}.{ending}") as f:
                f.write(data.astype("<i8").tobytes())
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "name": name, "documents": len(offsets) - 1, "tokens": int(offsets[-1]), "nulls": nulls}],
            pa.schema([("part", pa.int32()), ("name", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("nulls", pa.int64())]),
        )

    manifest = ordered.mapInArrow(run, _MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


class _Stored:
    """A file as an array of which slices are taken: mapped where the file system is local, else read by offset."""

    def __init__(self, system: fs.FileSystem, path: str, kind: str):
        self.kind, self.size = np.dtype(kind), system.get_file_info(path).size // np.dtype(kind).itemsize
        local = isinstance(system, fs.LocalFileSystem) and self.size
        self.mapped = np.memmap(path, kind, "r") if local else None
        self.file = None if local else system.open_input_file(path)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[part]
        first, last, _ = part.indices(self.size)
        wide = self.kind.itemsize
        return np.frombuffer(self.file.read_at(max(0, last - first) * wide, first * wide), self.kind)


def read_tokens(spark: SparkSession, folder: str, wide: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of its ids for every document of the files in ``folder``.

    ``start`` counts the ids of all documents before it: the part's base, from prefix sums over the manifest
    (a row per file), and the offset within the part. Each part is read by one task through a memory map.
    """
    kind = "<u4" if wide else "<u2"
    parts = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").orderBy("part").collect()
    bases = np.cumsum([0, *(p["tokens"] for p in parts)]).tolist()
    listed = [(p["name"], b, p["nulls"]) for p, b in zip(parts, bases)]
    frame = spark.createDataFrame(listed, "name string, base long, nulls long")
    frame = frame.repartition(max(1, len(listed)), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        for batch in batches:
            for p in batch.to_pylist():
                ids = _Stored(system, f"{path}/{p['name']}.bin", kind)
                offsets = _Stored(system, f"{path}/{p['name']}.idx", "<i8")
                names = _Stored(system, f"{path}/{p['name']}.ids", "<i8")
                for at in range(0, len(names), 10_000):
                    cut = offsets[at : at + 10_001]
                    held = ids[int(cut[0]) : int(cut[-1])]
                    checks = [zlib.crc32(held[a:b].astype("<u4").tobytes()) for a, b in zip((cut[:-1] - cut[0]).tolist(), (cut[1:] - cut[0]).tolist())]
                    missing = np.arange(at, at + len(checks)) < p["nulls"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(names[at : at + 10_000]), mask=missing), pa.array(p["base"] + cut[:-1]), pa.array(np.diff(cut)), pa.array(checks, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return frame.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the tokens of all documents to a new folder in the shared one and read them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer_path, doc_id=doc_id, text=text)
    return read_tokens(docs.sparkSession, folder)
