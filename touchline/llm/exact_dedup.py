"""Exact duplicates by merging runs of digests as a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import ROW, numbered
from touchline.session import durable

SPACE = r"[\x20\x09-\x0D]+"
FAN_IN = 8


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Row, doc_id, run and digest of every row, written once. A run is what one partition read."""
    plain = numbered(docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("_plain")))
    return durable(
        plain.select(
            ROW,
            "doc_id",
            F.spark_partition_id().alias("run"),
            F.unhex(F.sha2("_plain", 256)).alias("digest"),
            F.length("_plain").alias("size"),
        ),
        "digests",
    )


def merge_runs(entries: DataFrame, runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merge runs of (digest, size, first, rows) until one is left: per digest its first row and row count.

    Level by level ``fan_in`` neighbouring runs become one. A level is keyed by (merged run, digest), so a
    digest in a third of all rows has one entry per run and never meets in one group of rows; each merge
    keeps the smallest identifier among entries whose digest and text length agree.
    """
    while True:
        entries = (
            entries.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy("run", "digest", "size")
            .agg(F.min("first").alias("first"), F.sum("rows").alias("rows"))
        )
        runs = -(-runs // fan_in)
        if runs <= 1:
            return entries.drop("run")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """Each row with the row of its group that stays: row, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they agree after each run of ASCII white space became one space; null counts as
    empty. The smallest doc_id stays; a null doc_id comes after all others, and of rows that repeat
    the same doc_id the first read stays, so exactly one row per group is kept. An empty table gives an
    empty result; further columns of ``docs`` are left out.
    """
    rows = digest_runs(docs, doc_id, text)
    runs = int((rows.agg(F.max("run")).first()[0] or 0) + 1)
    first = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))
    leaves = rows.groupBy("run", "digest", "size").agg(F.min(first).alias("first"), F.count("*").alias("rows"))
    whole = merge_runs(leaves, runs, fan_in).select(
        "digest", "size", F.col("first.id").alias("keep_id"), F.col("first.row").alias("_keep"), F.col("rows").alias("group_size")
    )
    # winners go back down: first to the runs that hold the digest, then to the rows of each run
    served = leaves.select("run", "digest", "size").join(whole, ["digest", "size"])
    return rows.join(served, ["run", "digest", "size"]).select(
        ROW,
        "doc_id",
        "keep_id",
        "group_size",
        (F.col(ROW) == F.col("_keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that repeat another one's text."""
    gone = exact_groups(docs, doc_id, text).where(~F.col("kept")).select(F.col(ROW).alias("_gone"))
    return numbered(docs, "_number").join(gone, F.col("_number") == F.col("_gone"), "left_anti").select(*docs.columns)
