"""Registered queries of the operators and the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import exact_dedup, language, neighbours, packing, passages, pieces, quality, repeats, resampling, secret_scan, simhash, token_files, turn_checks, turns
from touchline.llm.common import table

#: where the vocabularies of the public tokenizers are
TOKENIZERS = "public_tokenizers"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def vocabulary(name: str, package: str = TOKENIZERS) -> str:
    return importlib.import_module(package).path(name)


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


@_query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays for every document."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@_query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 400 bytes, and the text left."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@_query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's pieces and of the text they decode to."""
    found = pieces.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of every document."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@_query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read from the files written."""
    return token_files.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@_query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language.identify(table(spark, sf_dir, "documents"))


@_query
def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of every row whose id is divisible by 20."""
    return neighbours.search(table(spark, sf_dir, "embeddings"))


@_query
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, noisy score and rank of every document, drawn towards the benchmark's texts."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation."""
    return turns.repaired(table(spark, sf_dir, "conversations"))


@_query
def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without windows of 20 words that also start earlier, and the words left."""
    found = passages.remove_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


CHECKS["op2_exact_dedup"] = r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS plain FROM documents
), groups AS (
  SELECT plain, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY plain
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256
FROM texts JOIN groups USING (plain)
"""
CHECKS["op13_passages"] = r"""
WITH texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, pos, array_to_string(words[pos : pos + 19], ' ') AS shown
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos FROM texts WHERE len(words) >= 20)
), again AS (
  SELECT doc_id, pos FROM windows QUALIFY row_number() OVER (PARTITION BY shown ORDER BY doc_id, pos) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS place FROM again
), lost AS (
  SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE
    list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(places, i)), lambda i: words[i]) END, ' ')) AS kept_sha256
FROM texts LEFT JOIN lost USING (doc_id)
"""
CHECKS["op12_conversations"] = turn_checks.repair_sql()
CHECKS["op1_secret_scan"] = secret_scan.report_sql()
