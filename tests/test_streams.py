"""Streams with keyed state and the owner index: equal to the batch forms, also after a stopped batch."""

from __future__ import annotations

import random
import shutil
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators.conflicts import newest_owners
from shelfmark.operators.gates import cooldown_gate
from shelfmark.operators.intake import register_batch
from shelfmark.streaming import jobs, keyed, owner_index

HOUR = 3_600_000_000


def greedy(times, last, width):
    kept = []
    for at in sorted(times):
        if last is None or at >= last + width:
            kept.append(at)
            last = at
    return kept


def test_kept_times():
    draw = random.Random(2)
    for _ in range(300):
        times = sorted({draw.randrange(200) for _ in range(draw.randrange(40))})
        last, width = draw.choice([None, draw.randrange(200)]), draw.choice([1, 3, 20, 500])
        assert keyed.kept_times(np.array(times, np.int64), last, width) == greedy(times, last, width)


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Handle:
    def __init__(self):
        self.value, self.timers = Value(), []

    def getValueState(self, *_):
        return self.value

    def registerTimer(self, at):
        self.timers.append(at)


class Fired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def test_state_is_one_time_and_goes_when_nothing_can_be_refused_for_it():
    gate, handle = keyed.Cooldown(10), Handle()
    gate.init(handle)
    rows = lambda *seconds: iter([pd.DataFrame({"ts": pd.to_datetime(list(seconds), unit="s")})])
    first = list(gate.handleInputRows(("k",), rows(5, 1, 1, 30), None))
    assert first[0]["ts"].tolist() == list(pd.to_datetime([1, 30], unit="s")) and handle.timers == [40_000]
    assert not list(gate.handleInputRows(("k",), rows(31, 39), None)) and handle.timers == [40_000]
    list(gate.handleInputRows(("k",), rows(40), None))
    assert handle.timers == [40_000, 50_000]
    list(gate.handleExpiredTimer(("k",), None, Fired(40_000)))
    assert handle.value.exists()  # a later event passed meanwhile
    list(gate.handleExpiredTimer(("k",), None, Fired(50_000)))
    assert not handle.value.exists()


def test_environments_of_one_group_share_a_call_and_a_state():
    gate, handle = keyed.Cooldown(10), Handle()
    gate.init(handle)
    at = lambda second: pd.to_datetime(second, unit="s")
    rows = lambda *pairs: iter([pd.DataFrame(pairs, columns=["environment", "ts"]).assign(ts=lambda f: f["ts"].map(at))])
    passed = lambda frames: [(r.environment, r.ts) for f in frames for r in f.itertuples()]
    first = gate.handleInputRows((3,), rows(("b", 7), ("a", 5), (None, 9), ("a", 1), ("b", 30), ("a", 1)), None)
    assert sorted(passed(first), key=str) == sorted([("b", at(7)), ("b", at(30)), ("a", at(1)), (None, at(9))], key=str)
    assert handle.timers == [40_000]
    watermark = type("Now", (), {"getCurrentWatermarkInMs": lambda self: 19_000})()
    second = gate.handleInputRows((3,), rows(("b", 39), ("a", 11), (None, 18), ("c", 12)), watermark)
    assert passed(second) == [("a", at(11)), ("c", at(12))]
    assert dict(zip(*handle.value.get())) == {"b": 30_000_000, "a": 11_000_000, "c": 12_000_000}  # a null's is over
    list(gate.handleExpiredTimer((3,), None, Fired(40_000)))
    assert not handle.value.exists()


@pytest.fixture(scope="module")
def events(spark):
    draw = random.Random(8)
    rows = [("hot" if draw.random() < 0.4 else f"env{draw.randrange(30)}", draw.randrange(20 * 24 * 3600)) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "environment string, s bigint")
    return frame.select("environment", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))


def kept_rows(frame):
    return sorted((r["environment"], r["ts"]) for r in frame.select("environment", "ts").collect())


def test_gate_over_batches_and_after_a_stopped_batch(spark, events, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/gate"
    cuts = [1_700_000_000 + d * 86_400 for d in (0, 5, 11, 20)]
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(source)
    for low, high in zip(cuts, cuts[1:]):
        events.filter((F.unix_seconds("ts") >= low) & (F.unix_seconds("ts") < high)).repartition(3).write.mode("append").parquet(source)
        jobs.stream_cooldown_gate(stream(), target)
    expected = kept_rows(cooldown_gate(events))
    read = lambda: kept_rows(spark.read.schema("environment string, ts timestamp").parquet(f"{target}/out"))
    assert read() == expected
    # The last batch wrote its rows and stopped before it was committed.
    commits = sorted((int(p.name), p) for p in Path(target, "_progress/commits").iterdir() if p.name.isdigit())
    commits[-1][1].unlink()
    (commits[-1][1].parent / f".{commits[-1][0]}.crc").unlink(missing_ok=True)
    jobs.stream_cooldown_gate(stream(), target)
    assert read() == expected


@pytest.fixture(scope="module")
def registry(spark):
    rows = [
        (f"ds-{i}", f"Set {i}", "other", f"https://h.example/{i}", "1.0", ["eeg"], 1, True, "available", f"/r/{i}", "copy", i) for i in range(40)
    ]
    datasets = spark.createDataFrame(rows, [f.name for f in schemas.DATASETS]).withColumn("created_at", F.timestamp_seconds("created_at"))
    datasets = datasets.select(*[F.col(f.name).cast(f.dataType) for f in schemas.DATASETS])
    aliases = datasets.select("dataset_id", F.lit("name").alias("kind"), F.col("name").alias("value")).unionByName(
        datasets.select("dataset_id", F.lit("url").alias("kind"), F.col("source_url").alias("value"))
    )
    return datasets, aliases


def requests_of(spark, batch):
    draw = random.Random(batch)
    rows = []
    for k in range(25):
        name = draw.choice([f"Set {draw.randrange(60)}", f"new {draw.randrange(40)}", f"NEW {draw.randrange(40)}", "hot name"])
        alias = draw.choice([[], [f"alias {draw.randrange(30)}"], [f"Set {draw.randrange(80)}"], ["hot alias"]])
        url = draw.choice([None, f"https://h.example/{draw.randrange(80)}", f"https://n.example/{draw.randrange(50)}"])
        rows.append((f"r-{batch:02d}-{k:02d}", f"/in/{batch}/{k}", name, "other", url, None, ["eeg"], "copy", alias, 5, True, batch * 1000 + k))
    frame = spark.createDataFrame(rows, (
        "request_id string, source string, name string, provider string, url string, version string, modalities array<string>, "
        "storage_mode string, aliases array<string>, size_bytes bigint, source_is_dir boolean, at bigint"
    ))
    return frame.withColumn("requested_at", F.timestamp_seconds(F.col("at") + 10_000)).drop("at")


def test_intake_over_batches_merges_and_a_batch_that_runs_again(spark, registry, tmp_path, monkeypatch):
    monkeypatch.setattr(owner_index, "EVERY", 2)
    source, target = f"{tmp_path}/in", f"{tmp_path}/intake"
    datasets, aliases = registry
    jobs.seed_intake_registry(datasets, aliases, target)
    stream = lambda schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    expected = []
    for batch in range(5):
        asked = requests_of(spark, batch)
        asked.repartition(2).write.mode("append").parquet(source)
        jobs.stream_intake_gate(stream(asked.schema), target)
        change = register_batch(asked, datasets, aliases)
        expected += [tuple(r) for r in change.outcomes.collect()]
        datasets = spark.createDataFrame(datasets.unionByName(change.datasets).collect(), datasets.schema)
        aliases = spark.createDataFrame(aliases.unionByName(change.aliases).collect(), aliases.schema)
    key = lambda rows: sorted(rows, key=repr)
    assert key(read_rows(spark, target)) == key(expected)
    assert {row[1] for row in expected} >= {"accepted", "conflict"}
    held = {p.name for p in Path(target, "owners").iterdir()}
    assert {"base-2", "base-4", "delta-4"} <= held and not {"base-0", "delta-0", "delta-1"} & held
    shutil.rmtree(Path(target, "outcomes", "batch_id=4"))
    (Path(target, "_progress/commits") / "4").unlink()
    (Path(target, "_progress/commits") / ".4.crc").unlink(missing_ok=True)
    jobs.stream_intake_gate(stream(asked.schema), target)
    assert key(read_rows(spark, target)) == key(expected)


def read_rows(spark, target):
    layout = "request_id string, outcome string, reason string, owner_id string, dataset_id string, batch_id bigint"
    return [tuple(r) for r in spark.read.schema(layout).parquet(f"{target}/outcomes").drop("batch_id").collect()]


def test_index_names_the_newest_owner_and_reads_its_buckets_only(spark, registry, tmp_path):
    datasets, aliases = registry
    index = owner_index.OwnerIndex(spark, f"{tmp_path}/owners")
    index.seed(datasets, aliases)
    keys = spark.createDataFrame([("name|set 3",), ("id|ds-7",), ("nobody",), ("value|Set 9",)], "key string")
    found = {r["key"]: r["owner"]["dataset_id"] for r in index.lookup(keys, 0).collect()}
    assert found == {"name|set 3": "ds-3", "id|ds-7": "ds-7", "value|Set 9": "ds-9"}
    plan = index.lookup(keys, 0)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    everything = newest_owners(datasets, aliases)
    assert sorted(index.lookup(everything, 0).collect()) == sorted(everything.collect())
