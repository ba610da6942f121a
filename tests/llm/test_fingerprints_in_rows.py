"""Fingerprints are made in the row of a line: no row for a feature, no shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.llm import line_dedup


def test_counters_of_all_widths_agree_and_nothing_is_exploded(spark):
    sizes = [0, 1, 2, 7, 8, 123, 124, 125, 126, 127, 128, 300, 32_764, 32_765, 32_766, 32_767, 32_768, 70_000]
    lines = [(n, " ".join(f"{n}word{i * 7919 % 99_991}" for i in range(n)) or "a") for n in sizes]
    lines += [(-1, " ".join(["same9"] * 125)), (-2, " ".join(["same9"] * 32_765)), (-3, " ".join(["same9"] * 40_000))]
    frame = spark.createDataFrame(lines, "doc_id int, normal string").repartition(4)
    made = line_dedup.with_simhash(frame)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate [" not in plan
    got = {r["doc_id"]: r["fingerprint"] % (1 << 64) for r in made.collect()}
    words = frame.select("doc_id", F.explode(F.split("normal", " ")).alias("w")).where(F.length("w") > 4)
    bit = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in range(64)]
    counted = words.select("doc_id", F.xxhash64("w").alias("h")).groupBy("doc_id").agg(F.count("*").alias("n"), *bit)
    expected = {r["doc_id"]: (r["n"], [r[f"b{k}"] for k in range(64)]) for r in counted.collect()}
    whole = {r["doc_id"]: r["h"] for r in frame.select("doc_id", F.xxhash64("normal").alias("h")).collect()}
    for n, _ in lines:
        count, bits = expected.get(n, (0, [0] * 64))
        if count % 2 == 0 and count < line_dedup.SHORT:
            bits, count = [b + (whole[n] >> k & 1) for k, b in enumerate(bits)], count + 1
        assert got[n] == sum(1 << k for k, b in enumerate(bits) if 2 * b > count), n
