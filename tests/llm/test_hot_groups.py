"""Groups whose texts share most of their words: pairs that cannot be similar must cost no row."""

from __future__ import annotations

import random

import numpy as np

from shelfmark.llm import groups, order_minhash


def test_texts_of_one_filler_are_ruled_out_before_they_are_paired(spark, monkeypatch):
    draw = random.Random(31)
    filler = ["is", "onhe"] * 300
    docs = [(k, " ".join([f"w{draw.randrange(10**6)}" for _ in range(200)] + filler)) for k in range(30)]
    docs.append((100, docs[0][1] + " one more word"))
    kept, paired = groups.stored, []

    def stored(df, label):
        frame = kept(df, label)
        if label == "across":
            paired.append(frame.count())
        return frame

    monkeypatch.setattr(groups, "stored", stored)
    rows = order_minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == {**{k: k for k in range(30)}, 100: 0}
    assert sum(paired) == 0


def test_edits_change_no_more_parities_than_they_leave_room_for():
    draw = np.random.default_rng(32)
    for n in (1, 5, 40, 900, 9000):
        codes = draw.integers(256, 256 + n // 2 + 1, n).astype("<u2")
        edited = codes.copy()
        places = draw.choice(n, n // 5, replace=False)
        edited[places] = draw.integers(256, 40_000, n // 5)
        for other, room in ((edited, 2 * (n // 5)), (codes[n // 5 :], n // 5)):
            odd = np.bitwise_xor(order_minhash.parities(codes), order_minhash.parities(other)).view(np.uint64)
            folded = np.bitwise_xor.reduce(odd.reshape(-1, order_minhash.FOLDED))
            counts = np.abs(order_minhash.bag(codes).astype(int) - order_minhash.bag(other)).sum()
            assert max(np.bitwise_count(odd).sum(), np.bitwise_count(folded).sum(), counts) <= room
