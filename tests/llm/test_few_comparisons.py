"""What comparisons cost: pairs a round, letters an alignment looks at, bits of a filter."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from shelfmark.llm import common, groups


def plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_few_edits_is_the_plain_distance(spark):
    draw = random.Random(41)
    pairs = [("", ""), ("", "a"), ("a", "a"), ("ab" * 40, "ab" * 36), ("é日😀" * 9, "é日" + "é日😀" * 8), ("x" * 30, "x" * 25)]
    for _ in range(400):
        a = "".join(draw.choice("abé日😀 ") for _ in range(draw.randrange(60)))
        b = list(a)
        for _ in range(draw.randrange(1 + len(a) // 3)):
            at = draw.randrange(len(b) + 1)
            b[at : at + draw.randrange(3)] = draw.choices("abé日😀 ", k=draw.randrange(3))
        pairs.append((a, "".join(b)))
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").repartition(2)
    got = dict(frame.select("k", common.few_edits(F.col("a"), F.col("b"), 0.8, (0.05, 0.3))).collect())
    for k, (a, b) in enumerate(pairs):
        assert got[k] == (plain_distance(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9)), (a, b)


def test_a_round_has_no_more_pairs_than_nodes(spark, monkeypatch):
    # 60 unlike nodes that meet in 40 buckets with another least node each, and three that are alike.
    members = [(b, f"n{k:03}") for b in range(40) for k in range(b, 60)] + [(100 + b, f"c{k}") for b in range(9) for k in range(3)]
    members += [(b, "c1") for b in range(3)]
    kept, stars = groups.stored, []

    def stored(df, label):
        frame = kept(df, label)
        if label == "stars":
            stars.append(frame.count())
        return frame

    monkeypatch.setattr(groups, "stored", stored)
    frame = spark.createDataFrame(members, "bucket bigint, node string")
    traits = lambda nodes: nodes.withColumn("trait", F.substring("node", 1, 1))
    verify = lambda pairs: pairs.where("a LIKE 'c%' AND b LIKE 'c%'")
    fit = lambda a, b: (a == "c") & (b == "c")
    found = groups.similar_groups(groups.crowded(frame), verify, fit, traits).collect()
    assert sorted(map(tuple, found)) == [("c0", "c0"), ("c1", "c0"), ("c2", "c0")]
    assert stars and max(stars) <= 63


def test_filter_grows_with_its_keys(spark):
    assert common.filter_bits(0) == common.filter_bits(1) == common.LEAST_BITS
    assert common.filter_bits(1 << 18) == 1 << 24 and common.filter_bits(1 << 40) == common.FILTER_BITS
    rows = spark.range(20_000).select(F.col("id").alias("k"))
    wanted = rows.where("k % 7 = 0")
    met = {r["k"] for r in common.sifted(rows, "k", wanted).collect()}
    others = {r["k"] for r in common.sifted(rows, "k", wanted, met=False).collect()}
    assert met >= set(range(0, 20_000, 7)) and not met & others and len(met | others) == 20_000 and len(met) < 3500
