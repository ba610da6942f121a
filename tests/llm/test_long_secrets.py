"""Secret scans of very long candidate strings and of texts with very many matches end in time."""

from __future__ import annotations

import random
import time

from shelfmark.llm import secret_scan
from shelfmark.llm.common import ship_package


def scanned(spark, text):
    ship_package(spark)
    start = time.perf_counter()
    (row,) = secret_scan.digest(secret_scan.scan_secrets(spark.createDataFrame([(1, text)], "doc_id int, text string"))).collect()
    return row, time.perf_counter() - start


def test_a_string_of_a_million_characters(spark):
    draw = random.Random(1)
    letters = [c for c in secret_scan.ALPHABET[:62] if c not in "xX"]  # no placeholder of the allow-list by chance
    row, seconds = scanned(spark, "see " + "".join(draw.choice(letters) for _ in range(1_000_000)) + " end")
    kind, start, end = row["spans"].split(":")
    assert kind == "base64_entropy" and int(start) < 50 and int(end) > 999_950 and seconds < 60


def test_a_hundred_thousand_matches(spark):
    row, seconds = scanned(spark, "password=abcdef1 " * 100_000)
    assert row["n_assign"] == 100_000 and seconds < 60
    assert row["spans"].split(",")[99_999] == f"assign:{99_999 * 17}:{99_999 * 17 + 16}"


def test_blocks_of_matches_join_without_a_gap(spark):
    for n in (1, 255, 256, 257, 600):
        row, _ = scanned(spark, "".join(f"token: value{k:06d} " for k in range(n)))
        assert row["spans"] == ",".join(f"assign:{19 * k}:{19 * k + 18}" for k in range(n))
