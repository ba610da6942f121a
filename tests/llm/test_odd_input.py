"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import (
    byte_bpe, decontaminate, kneser_ney, line_dedup, order_minhash, pii, quality, secret_scan, spot_signatures, token_counts,
)
from shelfmark.llm.common import ship_package

# Names that operators use inside; input columns of these names must not get in the way.
CLASHING = ("doc, node, key, bucket, row, removed, hash, id, score, predicted, keep, place, root, n_chars, line_no, ids, base").split(", ")
LONG = "word " * 30_000 + "\n" + "x" * 50_000


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@pytest.fixture(scope="module")
def odd(spark):
    ship_package(spark)
    texts = [
        (1, "The quick brown fox jumps over the lazy dog and runs\nsecond line of this text"), (2, None), (3, ""), (4, LONG),
        (5, "same text for two rows\nwith two lines"), (5, "same text for two rows\nwith two lines"), (None, "a row without id"),
        (6, "\x00 　 \U0001f600 mail me.now@host.example.org"), (7, "!!!"), (8, "same text for two rows\nwith two lines"),
    ]
    return spark.createDataFrame(texts, "doc_id bigint, text string").select("*", *[F.lit(7).cast("bigint").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (None, "no id"), (1, "quick brown fox jumps over the lazy dog")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1), (4, 0), (5, 1), (None, 1), (7, 0), (6, None), (3, 0)], "doc_id bigint, quality int"
    )


def test_quality(spark, odd, labels):
    model = quality.learn(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r["predicted"] for r in rows)
    assert quality.score(odd.limit(0), quality.learn(odd.limit(0), labels)).count() == 0


def test_line_dedup(odd):
    rows = {(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(odd).select("doc_id", "text").collect()}
    # Rows 5 are one document and hold the first occurrence; document 8 loses both its lines.
    assert (5, "same text for two rows\nwith two lines") in rows and (8, "") in rows and (2, None) in rows and (3, "") in rows
    kept = line_dedup.keep_documents(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 5, 6, 7]
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_secrets(odd):
    rows = secret_scan.digest(secret_scan.scan_secrets(odd)).collect()
    assert len(rows) == 10 and all(r["spans"] == "" for r in rows)
    assert secret_scan.scan_secrets(odd.limit(0)).count() == 0


def test_byte_bpe(odd):
    import public_tokenizers

    rows = byte_bpe.round_trip(odd, public("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    given = sorted((r["doc_id"] or 0, r["text"] or "") for r in odd.collect())
    assert sorted((r["doc_id"] or 0, r["text"]) for r in rows) == given
    assert byte_bpe.round_trip(odd.limit(0), public("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_token_counts(odd):
    rows = token_counts.token_counts(odd, public("word_bpe_49k.json"), 2048).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == 10 and (by_id[2]["n_bytes"], by_id[2]["n_tokens"]) == (0, 0) and by_id[4]["over_limit"]
    assert token_counts.token_counts(odd.limit(0), public("word_bpe_49k.json"), 2048).count() == 0


def test_near_duplicates(odd):
    rows = order_minhash.near_duplicates(odd).collect()
    classes = {r["doc_id"]: r["class_id"] for r in rows}
    assert len(rows) == 10 and classes[2] == classes[3] == 2 and classes[8] == 5 and classes[7] == 7
    kept = order_minhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 4, 5, 6, 7]
    assert order_minhash.near_duplicates(odd.limit(0)).count() == 0


def test_language_model(odd):
    rows = kneser_ney.score_held_out(odd).collect()
    assert len(rows) == 10 and all(r["score"] <= 0 and r["n_tokens"] >= 1 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {1}
    assert kneser_ney.score_held_out(odd.limit(0)).count() == 0
    alone = kneser_ney.score(odd, kneser_ney.learn(odd.limit(0))).collect()
    assert {r["base_score"] for r in alone} == {0.0} and {r["score"] for r in alone} == {0.0}


def test_personal_data(odd):
    rows = {r["doc_id"]: r for r in pii.digest(pii.find_personal_data(odd, pii.Tagger(9))).collect()}
    assert rows[6]["n_email"] == 1 and rows[6]["spans"].startswith("email:11:") and rows[2]["spans"] == ""
    assert pii.find_personal_data(odd.limit(0), pii.Tagger(9)).count() == 0


def test_fingerprints(odd):
    rows = spot_signatures.digest(spot_signatures.edited_fingerprints(odd)).collect()
    assert len(rows) == 10 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    same = {r["fingerprint"] for r in rows if r["doc_id"] in (5, 8)}
    assert len(same) == 1
    assert spot_signatures.edited_fingerprints(odd.limit(0)).count() == 0


def test_decontamination(odd, benchmark):
    rows = decontaminate.contaminated(odd, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1, 1)}
    kept = decontaminate.keep_clean(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == 9
    assert decontaminate.contaminated(odd.limit(0), benchmark).count() == 0
    assert decontaminate.contaminated(odd, benchmark.limit(0)).count() == 0


def test_stages_are_five_and_named():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "byte_bpe",
    ]
