"""Long benchmark items, ids of any type, and alignment against a plain table."""

from __future__ import annotations

import random

import numpy as np

from shelfmark.llm import decontaminate as d
from shelfmark.llm.common import ship_package


def plain_alignment(item, words):
    """Best local score by the whole table."""
    best, table = 0, [[0] * (len(words) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(words, 1):
            table[i][j] = max(
                0, table[i - 1][j - 1] + (d.MATCH if a == b else d.MISMATCH), table[i - 1][j] + d.GAP, table[i][j - 1] + d.GAP
            )
            best = max(best, table[i][j])
    return best


def test_smith_waterman_against_a_plain_table():
    draw = random.Random(6)
    for _ in range(300):
        item = [draw.randrange(6) for _ in range(draw.randrange(1, 12))]
        words = [draw.randrange(6) for _ in range(draw.randrange(0, 25))]
        score, begin, end = d.smith_waterman(np.array(item, np.uint64), np.array(words, np.uint64))
        assert score == plain_alignment(item, words)
        assert plain_alignment(item, words[begin:end]) == score  # the span alone gives the score


def test_a_long_item_is_held_once_and_found(spark):
    ship_package(spark)
    draw = random.Random(7)
    long_item = [f"w{draw.randrange(10**6)}" for _ in range(20_000)]
    copy = list(long_item)
    for at in draw.sample(range(20_000), 1500):
        copy[at] = "changed"
    bench = spark.createDataFrame([(1, " ".join(long_item)), (2, "one short item of a few words")], "item_id smallint, text string")
    items = d.benchmark_items(bench)
    assert sorted(len(r["words"]) for r in items.collect()) == [7, 20_000]
    assert "words" not in d.benchmark_seeds(items).columns
    docs = spark.createDataFrame([(5, "before " + " ".join(copy) + " after"), (6, "nothing here")], "doc_id bigint, text string")
    rows = d.contaminated(docs, bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in rows] == [(5, 1)] and rows[0]["score"] > 0.8
    assert [r["doc_id"] for r in d.keep_clean(docs, bench).collect()] == [6]


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([(1, "a passage of several words that is copied")], "doc_id int, text string")
    for kind, value in (("smallint", 3), ("tinyint", 3), ("double", 3.5), ("string", "x"), ("date", None)):
        import datetime

        value = datetime.date(2024, 1, 1) if kind == "date" else value
        bench = spark.createDataFrame([(value, "a passage of several words that is copied")], f"item_id {kind}, text string")
        assert [(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, bench).collect()] == [(1, value)]
