"""Rounds over few rows of buckets must not cost a task for each of many partitions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from shelfmark.llm import groups


def test_rounds_of_few_rows_are_one_task(spark, monkeypatch):
    draw = random.Random(61)
    rows = [(draw.randrange(40), k) for k in range(300) for _ in range(3)] + [(100 + k % 7, k) for k in range(0, 300, 5)]
    frame = spark.createDataFrame(rows, "bucket bigint, node bigint").withColumn("trait", F.col("node") % 10)
    fit = lambda a, b: a == b
    verify = lambda pairs: pairs.where("(b - a) % 30 = 0")
    kept, files = groups.stored, []

    def stored(df, label):
        stored_rows = kept(df, label)
        if label == "loose":
            files.append(len(stored_rows.inputFiles()))
        return stored_rows

    monkeypatch.setattr(groups, "stored", stored)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["node"]: r["root"] for r in groups.similar_groups(groups.crowded(frame, fit), verify, fit).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    at: dict[int, set[int]] = {}
    for b, n in rows:
        at.setdefault(b, set()).add(n)
    root = {n: n for _, n in rows}
    for _ in range(30):
        for nodes in at.values():
            for a in nodes:
                for b in nodes:
                    if (a - b) % 30 == 0:
                        root[a] = root[b] = min(root[a], root[b])
    assert {n: got.get(n, n) for n in root} == root
    assert files and max(files) == 1
