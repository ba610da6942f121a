"""Rounds of a few links must not cost the driver stages and tasks."""

from __future__ import annotations

import random

from shelfmark.llm import groups


def test_rounds_of_few_links_shuffle_nothing(spark, monkeypatch):
    draw = random.Random(52)
    links = [(k, k + 1) for k in range(60)] + [(draw.randrange(100, 300), draw.randrange(100, 300)) for _ in range(150)]
    frame = spark.createDataFrame(links, "a bigint, b bigint").repartition(3)
    found, stages = [], []
    for few in (1 << 13, 0):
        monkeypatch.setattr(groups, "FEW_LINKS", few)
        spark.sparkContext.setJobGroup(f"few{few}", "components")
        found.append(sorted(map(tuple, groups.components(frame).collect())))
        stages.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"few{few}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found[0] == found[1] and stages[0] < stages[1]
