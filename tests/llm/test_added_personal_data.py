"""The tagger of personal data on held-out made-up data, and runs of digits of any length."""

from __future__ import annotations

import collections

import numpy as np
import pytest

from shelfmark.llm import pii
from shelfmark.llm.common import ship_package


@pytest.fixture(scope="module")
def tagger():
    made = pii.Tagger(1 + 2 * len(pii.KINDS))
    made.train(*pii.made_windows([], pii.MADE_WINDOWS))
    return made


def test_forms_that_the_base_rules_miss_are_added(spark, tagger):
    ship_package(spark)
    make = pii.Maker(np.random.default_rng(99))
    rows, truth = [], {}
    for i in range(400):
        kind = pii.KINDS[i % 4]
        head = " ".join(make.word(5) for _ in range(8)) + " "
        value = make.value(kind, missed=True)
        rows.append((i, head + value + " " + " ".join(make.word(6) for _ in range(8))))
        truth[i] = (len(head), len(head) + len(value), kind)
    rows += [(1000 + i, " ".join([make.word(6), make.other(), make.word(4)])) for i in range(200)]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id int, text string"), tagger).collect()
    right, given = collections.Counter(), collections.Counter()
    for row in found:
        for span in row["added"]:
            given[span["kind"]] += 1
            right[span["kind"]] += truth.get(row["doc_id"]) == (span["start"], span["end"], span["kind"])
    assert sum(right.values()) >= 0.95 * sum(given.values())
    assert all(right[kind] >= least for kind, least in {"email": 50, "ip": 90, "card": 90, "phone": 85}.items()), right  # of a hundred each


def test_base_spans_stay_whatever_the_tagger_says(spark, tagger):
    text = "call +49 (030) 123456-789, mail a.b@c.example.org, see 10.0.0.1 or 4111 1111 1111 1111"
    (row,) = pii.digest(pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id int, text string"), tagger)).collect()
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1)


def test_long_runs_of_digits():
    assert pii.base_spans("0" * 6000 + "1.2.3.4") == [(0, 6007, "ip")]
    assert pii.base_spans("9" * 6000 + ".2.3.4") == [] and pii.base_spans("1" * 50_000) == []
