"""The registered training-data queries; each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document."""
    from shelfmark.llm import secret_scan

    return secret_scan.digest(secret_scan.scan_secrets(table(spark, folder, "documents")))


@query
def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-level BPE ids of every document, and the text decoded from them."""
    import public_tokenizers

    from shelfmark.llm import byte_bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digest(byte_bpe.round_trip(table(spark, folder, "documents"), path, public_tokenizers.PATTERN))


@query
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document in the word-level vocabulary."""
    import public_tokenizers

    from shelfmark.llm import token_counts

    return token_counts.token_counts(
        table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048
    )


@query
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learnt from the labels that are not held out."""
    from shelfmark.llm import quality
    from shelfmark.llm.common import held_out

    docs = table(spark, folder, "documents")
    scored = quality.score(docs, quality.learn(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", "predicted")


@query
def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate class of every document."""
    from shelfmark.llm import order_minhash

    return order_minhash.near_duplicates(table(spark, folder, "documents")).drop("node")


@query
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that repeat, exactly or nearly, an earlier line."""
    from shelfmark.llm import line_dedup

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


@query
def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Spot-signature fingerprints of every document and of its edited text."""
    from shelfmark.llm import spot_signatures

    return spot_signatures.digest(spot_signatures.edited_fingerprints(table(spark, folder, "documents")))


@query
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold an exact or edited copy of a benchmark item, one row per document and item."""
    from shelfmark.llm import decontaminate

    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    from shelfmark.llm import pii

    docs = table(spark, folder, "documents")
    return pii.digest(pii.find_personal_data(docs, pii.learn(docs)))


@query
def op7_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document under a model learnt from those not held out."""
    from shelfmark.llm import kneser_ney

    return kneser_ney.score_held_out(table(spark, folder, "documents"))


@query
def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    from shelfmark.llm import impact_search

    ranked = impact_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return ranked.withColumn("doc_id", F.col("doc_id").cast("bigint"))


@query
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """How the tokens of two vocabularies meet in every document, and how usual those meetings are."""
    import public_tokenizers as files

    from shelfmark.llm import token_alignment

    aligned = token_alignment.align(
        table(spark, folder, "documents"), files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model"),
        files.path("byte_bpe_50k.tiktoken"), files.PATTERN,
    )
    return aligned.withColumn("doc_id", F.col("doc_id").cast("bigint"))


@query
def op12_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licences that every document names or is under."""
    from shelfmark.llm import license_scan

    scanned = license_scan.digest(license_scan.scan_licences(table(spark, folder, "documents")))
    return scanned.withColumn("doc_id", F.col("doc_id").cast("bigint"))
