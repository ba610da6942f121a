"""Cases that operators once lost: seeds, texts, links and rows beyond the usual ones."""

from __future__ import annotations

import random

from shelfmark.llm import decontaminate, line_dedup, order_minhash, quality


def test_all_texts_of_one_benchmark_id_are_searched(spark):
    draw = random.Random(21)
    texts = [[f"v{draw.randrange(10**5)}" for _ in range(n)] for n in (30, 12, 20)]
    docs = [(k, " ".join(["before"] * k + t + ["after"])) for k, t in enumerate(texts)] + [(9, " ".join(texts[0] + texts[1][:9]))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame([("q", " ".join(t)) for t in texts], "item_id string, text string")
    rows = decontaminate.contaminated(frame, bench).collect()
    got = sorted((r["doc_id"], r["item_id"], r["score"], r["first_word"], r["end_word"]) for r in rows)
    assert got == [(0, "q", 1.0, 0, 30), (1, "q", 1.0, 1, 13), (2, "q", 1.0, 2, 22), (9, "q", 1.0, 0, 30)]
    assert decontaminate.keep_clean(frame, bench).count() == 0


def test_items_of_common_words_keep_seeds_that_documents_can_hold(spark):
    draw = random.Random(22)
    common = [f"c{i}" for i in range(40)]
    item = [draw.choice(common) for _ in range(30)]
    item[14] = "onlyhere"  # a word that every copy has changed
    copy = [*item[:14], "other", *item[15:]]
    docs = [[draw.choice(common) for _ in range(4000)] for _ in range(50)]
    for k, at in ((0, 5), (1, 2000)):
        docs[k][at:at] = copy
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    rows = decontaminate.contaminated(frame, bench).collect()
    found = {(r["doc_id"], r["first_word"], r["end_word"]) for r in rows if r["score"] > 0.8}
    assert found == {(0, 5, 35), (1, 2000, 2030)}


def test_quality_sample_holds_one_row_of_an_id(spark):
    docs = [(i, f"text number {i} of some words") for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    once = quality.learn(spark.createDataFrame(docs, "doc_id bigint, text string"), labels)
    often = docs + [docs[3]] * 200 + [docs[4]] * 50
    again = quality.learn(spark.createDataFrame(often, "doc_id bigint, text string"), labels)
    assert (again.weights == once.weights).all() and again.least == once.least


def test_fingerprints_of_very_long_lines_move_with_the_edit(spark):
    words = [f"word{i}" for i in range(17_000)]
    lines = [(1, " ".join(words)), (2, " ".join(["inserted", *words]))]
    rows = line_dedup.with_simhash(spark.createDataFrame(lines, "doc_id int, normal string")).collect()
    a, b = (r["fingerprint"] % (1 << 64) for r in rows)
    assert (a ^ b).bit_count() <= 4


def test_copies_with_spread_edits_meet(spark):
    draw = random.Random(23)
    docs = []
    for share in (0.1, 0.15, 0.19):
        for n in (60, 300, 1000):
            for _ in range(10):
                words = [f"v{draw.randrange(10**5)}" for _ in range(n)]
                copy = list(words)
                for at in draw.sample(range(n), int(n * share)):
                    copy[at] = f"w{draw.randrange(10**6)}"
                docs += [words, copy]
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id int, text string")
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(frame).collect()}
    linked = [got[i] == got[i + 1] == i for i in range(0, len(docs), 2)]
    assert sum(linked) >= 0.95 * len(linked)
