"""Row numbers, hot-key lookups and flat byte views shared by the operators."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import durable

ROW = "_row"


def kept(name: str, make: Callable[[], object]) -> object:
    """``make()`` once per Python process. Functions travel by value, so their globals do not last beyond a task."""
    store = sys.__dict__.setdefault("_kept_by_tasks", {})
    if name not in store:
        store[name] = make()
    return store[name]


def forget() -> None:
    """Let go of what earlier steps keep in this Python process, which the next ones take over."""
    sys.__dict__.get("_kept_by_tasks", {}).clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stored(df: DataFrame) -> bool:
    """Whether ``df`` is rows of parquet files, each at most once."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation" and all(f.endswith(".parquet") for f in df.inputFiles())


def numbered(df: DataFrame, name: str = ROW) -> DataFrame:
    """``df`` with a number per row that every scan gives alike.

    A row of a parquet file has the number of its file, in order of their paths, and its place in the file,
    whatever splits or cores a scan has. Any other frame is written first and read from there. File numbers reach
    the rows by a broadcast of the paths, or by a plain join if the paths hold over 64 MB.
    """
    if not _stored(df):
        return numbered(durable(df, "rows"), name)
    bare = r"^[A-Za-z0-9+.-]+:/*"
    paths = sorted({re.sub(bare, "", f) for f in df.inputFiles()})
    # written, so that scans of the same rows share one exchange
    files = durable(df.sparkSession.createDataFrame(list(enumerate(paths)), "_numbered_of long, _numbered_file string").coalesce(1), "files")
    if sum(map(len, paths)) < 64 << 20:
        files = F.broadcast(files)
    meta = df.metadataColumn("_metadata")
    placed = df.withColumns({"_numbered_file": F.regexp_replace(meta.getField("file_path"), bare, ""), "_numbered_at": meta.getField("row_index")})
    number = F.when(F.col("_numbered_of").isNull(), F.raise_error(F.lit("a file that was not listed"))).otherwise(F.shiftleft("_numbered_of", 38) + F.col("_numbered_at"))
    # never null, so that joins on it add no filter and share one exchange of the rows
    return placed.join(files, "_numbered_file", "left").withColumn(name, F.coalesce(number, F.lit(-1))).select(*(c for c in df.columns if c != name), name)


def spread_lookup(rows: DataFrame, key: list[str], values: DataFrame, row: str, salts: int = 64) -> DataFrame:
    """Left join ``values`` (unique by ``key``) to ``rows`` whose keys may be hot.

    Each (key, salt) fetches its value once; rows then meet it by (key, salt), so a key with a third
    of all rows is spread over ``salts`` groups. ``row`` is any column that differs between rows. Key
    columns may not be null.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(row)), F.lit(salts)).cast("int"))
    served = salted.select(*key, "_salt").distinct().join(values, key, "left")
    return salted.join(served, [*key, "_salt"], "left").drop("_salt")


def skew_join(rows: DataFrame, key: list[str], values: DataFrame, counts: DataFrame, count: str, row: str, salts: int = 64) -> DataFrame:
    """Inner join of ``values`` (unique by ``key``) to ``rows`` in one shuffle, keys of very many rows dealt over ``salts``.

    ``counts`` has the number of rows of each key that may be frequent. At most 4,096 keys can hold more than that share
    of all counted rows, so those are broadcast. ``row`` is any column that differs between rows.
    """
    share = (counts.agg(F.sum(count)).first()[0] or 0) / 4096
    hot = F.broadcast(counts.where(F.col(count) > max(share, 64)).select(*key, F.lit(True).alias("_hot")))
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(row), F.lit(salts)).cast("int")).otherwise(0))
    served = values.join(hot, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.drop("_hot").join(served.drop("_hot"), [*key, "_salt"]).drop("_salt")


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one array of UTF-8 bytes and the n + 1 offsets in it; null is empty."""
    texts = pc.fill_null(column, "").cast(pa.large_binary())
    _, ends, data = texts.buffers()
    if len(texts) == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_texts(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return pc.fill_null(column, "").cast(pa.large_binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: str, most_bytes: int):
    """Cut a batch so that the texts of each part hold about ``most_bytes``; a longer text is a part of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most_bytes:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += int(n)
    if first < batch.num_rows:
        yield batch.slice(first)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of ``starts[i], starts[i] + 1, ...`` (``counts[i]`` of them) in one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
