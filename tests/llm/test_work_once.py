"""Work that must be done once: normalising a line, cutting a text."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from shelfmark.llm import line_dedup


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_normalised_once_and_features_are_long_words(spark, monkeypatch):
    kept, cut = line_dedup.stored, []

    def stored(df, label):
        if label == "lines":
            cut.append(optimized(df))
        return kept(df, label)

    monkeypatch.setattr(line_dedup, "stored", stored)
    rows = [(1, "Alpha, beta!\n-- --\n日本語 x\nÀ é 😀"), (2, "alpha beta\n---\nother\nÀ é"), (None, None)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: rows[0][1], 2: "---\nother", None: None}
    assert len(cut) == 1 and cut[0].count("regexp_replace(") == 1


def test_fingerprints_of_short_long_and_no_features(spark):
    draw = random.Random(51)
    letters = "abé日😀1"
    lines = [" ".join("".join(draw.choices(letters, k=draw.randrange(1, 8))) for _ in range(draw.randrange(1, 20))) for _ in range(200)]
    lines += ["a b c d", "abcde", "日本語日本", "日本語日", " ".join(["some"] * 9)]
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id int, normal string")
    hashes: dict[int, list[int]] = {}
    words = frame.select("doc_id", F.explode(F.split("normal", " ")).alias("w")).select("doc_id", "w", F.xxhash64("w").alias("h"))
    for r in words.collect():
        if len(r["w"]) > line_dedup.COMMON_LETTERS:
            hashes.setdefault(r["doc_id"], []).append(r["h"] % (1 << 64))
    whole = {r["doc_id"]: r["h"] % (1 << 64) for r in frame.select("doc_id", F.xxhash64("normal").alias("h")).collect()}
    got = {r["doc_id"]: r["fingerprint"] % (1 << 64) for r in line_dedup.with_simhash(frame).collect()}
    assert len(got) == len(lines)
    for k in whole:
        votes = list(hashes.get(k, []))
        votes += [whole[k]] if len(votes) % 2 == 0 and len(votes) < line_dedup.SHORT else []
        assert got[k] == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes)), lines[k]


def test_a_text_is_cut_once(spark):
    rows = [(k, f"{a}\nthe same line in all of them\n{b}") for k, a, b in ((0, "winter", "river"), (1, "garden", "bottle"), (2, "engine", "yellow"))]
    deduped = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id int, text string"))
    assert {r["doc_id"]: r["text"] for r in deduped.collect()} == {0: rows[0][1], 1: "garden\nbottle", 2: "engine\nyellow"}
    assert optimized(deduped).count("split(") == 1
