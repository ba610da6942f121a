"""From raw documents to token ids: rate, drop repeated lines, near-duplicates and benchmark copies, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import byte_bpe, decontaminate, line_dedup, order_minhash, quality
from shelfmark.llm.common import stored, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line; those of which nothing is left go."""
    return line_dedup.keep_documents(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, and one row, of each near-duplicate class."""
    return order_minhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids, and hashes of the ids and of the text decoded from them."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    return byte_bpe.digest(decoded, "ids")


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", without_repeated_lines),
    ("minhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("byte_bpe", token_ids),
]

# Learnt scores, fingerprints and alignments have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
