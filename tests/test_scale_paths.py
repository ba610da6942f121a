"""Hot keys, long chains and spilled parts: the split ways against brute force."""

from __future__ import annotations

import datetime as dt
import random
import re
import statistics

from pyspark.sql import functions as F

from shelfmark.functions.statistics import order_statistics
from shelfmark.operators import conflicts, failures, gates, search
from shelfmark.sources import listings

T0 = dt.datetime(2024, 1, 1)


def test_gate_with_a_hot_key(spark):
    rng = random.Random(5)
    events = [("hot", T0 + dt.timedelta(seconds=rng.randrange(0, 900_000))) for _ in range(400)]
    events += [(f"e{i % 7}", T0 + dt.timedelta(seconds=rng.randrange(0, 900_000))) for i in range(60)]
    expected = set()
    for key in {k for k, _ in events}:
        last = None
        for at in sorted(t for k, t in events if k == key):
            if last is None or at >= last + dt.timedelta(days=1):
                expected.add((key, at))
                last = at
    frame = spark.createDataFrame(events, "environment string, ts timestamp")
    got = gates.cooldown_gate(frame).collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_gate_goes_on_from_earlier_batches(spark):
    rng = random.Random(6)
    events = sorted(("hot", T0 + dt.timedelta(seconds=rng.randrange(0, 600_000))) for _ in range(200))
    whole = {tuple(r) for r in gates.cooldown_gate(spark.createDataFrame(events, "environment string, ts timestamp")).collect()}
    first = gates.cooldown_gate(spark.createDataFrame(events[:90], "environment string, ts timestamp"))
    last = first.groupBy("environment").agg(F.max("ts").alias("last"))
    second = gates.cooldown_gate(spark.createDataFrame(events[90:], "environment string, ts timestamp"), previous=last)
    assert {tuple(r) for r in first.unionByName(second).collect()} == whole


def test_claims_settle_like_one_by_one(spark):
    rng = random.Random(7)
    for case in range(3):
        claims = []
        for i in range(60):
            holder = f"h{rng.randrange(40)}" if case else f"h{i}"
            keys = {"hot"} if rng.random() < 0.33 else {f"k{rng.randrange(25)}" for _ in range(rng.randrange(1, 4))}
            claims += [(f"r{i:02d}", i, holder, key) for key in keys]
        taken, accepted = {}, {}
        for i in range(60):
            own = [c for c in claims if c[0] == f"r{i:02d}"]
            ok = all(taken.get(c[3], c[2]) == c[2] for c in own)
            accepted[f"r{i:02d}"] = ok
            if ok:
                taken.update({c[3]: c[2] for c in own})
        settled = conflicts.settle_claims(spark.createDataFrame(claims, "request_id string, ord bigint, holder string, key string"))
        got = {r["request_id"]: r["accepted"] for r in settled.collect()}
        assert {r: got.get(r, True) for r in accepted} == accepted


def test_failure_runs_across_blocks(spark):
    rng = random.Random(8)
    rows, expected = [], {}
    for operation in ("hot", "b", "c"):
        run = 0
        for attempt in range(1, 200 if operation == "hot" else 30):
            category = "server" if rng.random() < (0.93 if operation == "hot" else 0.6) else rng.choice(["network", "rate_limit"])
            run = run + 1 if category == "server" else 0
            rows.append((operation, attempt, category))
            expected[(operation, attempt)] = run
    frame = spark.createDataFrame(rows, "operation string, attempt int, category string")
    for block in (4, 7, 4096):
        got = {(r["operation"], r["attempt"]): r["server_run"] for r in failures.server_failure_runs(frame, block).collect()}
        assert got == expected


def test_order_statistics_are_exact(spark):
    rng = random.Random(9)
    rows = [("hot", rng.choice([rng.random() * 500, 12.5, -3.0])) for _ in range(999)] + [("one", 4.0), ("two", 1.0), ("two", 2.0)] + [("none", None)]
    got = {r["node"]: r for r in order_statistics(
        spark.createDataFrame(rows, "node string, value double"), "node", "value", {"median": (0.5, "midpoint"), "p95": (0.95, "nearest")}
    ).collect()}
    for key in ("hot", "one", "two"):
        held = sorted(v for k, v in rows if k == key)
        assert got[key]["median"] == statistics.median(held)
        assert got[key]["p95"] == held[max(0, -(-95 * len(held) // 100) - 1)]
    assert "none" not in got


def test_order_statistics_of_a_crowded_bucket(spark, monkeypatch):
    from shelfmark.functions import statistics as module

    monkeypatch.setattr(module, "CROWDED", 50)
    monkeypatch.setattr(module, "FANOUT", 7)
    rng = random.Random(19)
    # All in one octave bucket: many distinct values, many equal ones, and two apart by the last bit.
    rows = [("wide", 100 + rng.random() / 100) for _ in range(4000)] + [("flat", 7.5)] * 500
    rows += [("bits", rng.choice([1.0, 1.0 + 2**-52])) for _ in range(500)] + [("mixed", rng.choice([3.0, 3.0 + rng.random() / 1000])) for _ in range(900)]
    rows += [("signs", rng.choice([-1, 1]) * (5 + rng.random() / 100)) for _ in range(700)]
    got = {r["node"]: r for r in order_statistics(
        spark.createDataFrame(rows, "node string, value double"), "node", "value", {"median": (0.5, "midpoint"), "p95": (0.95, "nearest"), "least": (0.0, "nearest")}
    ).collect()}
    for key in ("wide", "flat", "bits", "mixed", "signs"):
        held = sorted(v for k, v in rows if k == key)
        assert got[key]["median"] == (held[(len(held) - 1) // 2] + held[len(held) // 2]) / 2
        assert (got[key]["p95"], got[key]["least"]) == (held[-(-95 * len(held) // 100) - 1], held[0])


def test_failure_runs_keep_columns_and_classify_once(spark):
    rng = random.Random(20)
    rows = [("op", k, rng.choice(["server", "server", "server", "network"]), f"x{k}") for k in range(300)]
    frame = spark.createDataFrame(rows, "operation string, attempt int, category string, more string")
    got = {r["attempt"]: (r["server_run"], r["more"]) for r in failures.server_failure_runs(frame, 8).collect()}
    run = 0
    for _, attempt, category, more in rows:
        run = run + 1 if category == "server" else 0
        assert got[attempt] == (run, more)


def test_cooldown_gate_of_one_key_inside_one_cooldown(spark):
    rng = random.Random(21)
    rows = [("hot", rng.randrange(1000)) for _ in range(3000)] + [("long", rng.randrange(100_000)) for _ in range(2000)] + [("once", 5)]
    events = spark.createDataFrame(rows, "environment string, s bigint").selectExpr("environment", "timestamp_seconds(s) ts")
    got = sorted((r["environment"], int(r["ts"].timestamp())) for r in gates.cooldown_gate(events, cooldown=1000).collect())
    expected = []
    for key in ("hot", "long", "once"):
        last = None
        for at in sorted({s for k, s in rows if k == key}):
            if last is None or at >= last + 1000:
                expected.append((key, at))
                last = at
    assert got == sorted(expected)


def test_name_search_with_pieces_that_all_names_hold(spark, monkeypatch):
    monkeypatch.setattr(search, "POSTED_TOGETHER", 40)
    rng = random.Random(23)
    names = {f"d{i}": rng.choice(["data set", "DataSet", "set"]) + rng.choice([" ", "_", "%", "\\"]) + str(rng.randrange(60)) for i in range(400)}
    names |= {"e1": "s", "e2": "äß", "e3": "set"}
    rows = [(k, n, "other", None, "1", ["eeg"], 1, True, "available", None, "copy", T0 + dt.timedelta(minutes=i % 50)) for i, (k, n) in enumerate(names.items())]
    datasets = spark.createDataFrame(rows, (
        "dataset_id string, name string, provider string, source_url string, version string, modalities array<string>, "
        "size_bytes bigint, size_bytes_known boolean, status string, storage_path string, storage_mode string, created_at timestamp"
    ))
    aliases = spark.createDataFrame([(k, "name_alias", f"alias {n}") for k, n in list(names.items())[:30]], "dataset_id string, kind string, value string")
    asked = ["set", "SET", "et", "s", "a set", "t_1", "%", "__", "___%_", "_", "t%7", "\\", "ß", "absent", "ali", "as d", "", "set 1", "%%", "s__3"]
    needles = spark.createDataFrame([(f"q{i}", n) for i, n in enumerate(asked)], "request_id string, needle string")
    created = {r[0]: r[-1] for r in rows}
    held = [(k, n) for k, n in names.items()] + [(k, f"alias {n}") for k, n in list(names.items())[:30]]
    got = {r["needle"]: (r["match_count"], r["newest_dataset_id"]) for r in search.search_by_name(needles, datasets, aliases).collect()}
    for needle in asked:
        pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in needle.lower())
        hits = {k for k, n in held if re.search(pattern, n.lower(), re.DOTALL)}
        newest = max(((created[k], k) for k in hits), default=(None, None))[1]
        assert got[needle] == (len(hits), newest), needle


def test_one_record_however_many_aliases(spark):
    datasets = spark.createDataFrame([("d", "set", "other", None, "unknown", ["eeg"], 1, True, "available", None, None)], (
        "dataset_id string, name string, provider string, source_url string, version string, modalities array<string>, "
        "size_bytes bigint, size_bytes_known boolean, status string, storage_path string, storage_mode string"
    ))
    aliases = spark.range(2500).selectExpr("'d' AS dataset_id", "'name_alias' AS kind", "format_string('v%05d', id) AS value")
    records = search.serialize_datasets(datasets, aliases.unionByName(aliases)).collect()
    assert [(r["dataset_id"], r["aliases"], r["url_aliases"]) for r in records] == [("d", 2500, 0)]
    assert search.alias_rollup(aliases.unionByName(aliases)).count() == 2500


def test_page_walk_on_random_graphs(spark):
    rng = random.Random(10)
    for _ in range(2):
        count = 40
        url = [listings_url(i) for i in range(count)]
        following = {i: (i + 1 if rng.random() < 0.75 else rng.randrange(count)) for i in range(count) if rng.random() < 0.9}
        folders = {i: [rng.randrange(count)] for i in range(count) if rng.random() < 0.15}
        pages = []
        for i in range(count):
            data = [f'{{"attributes":{{"kind":"folder"}},"relationships":{{"files":{{"links":{{"related":"{url[t]}"}}}}}}}}' for t in folders.get(i, [])]
            data.append(f'{{"attributes":{{"kind":"file","materialized_path":"/f{i}","size":{i}}},"links":{{"download":"https://d/{i}"}}}}')
            target = following.get(i, None)
            link = "null" if target is None or target >= count else f'"{url[target]}"'
            pages.append(("s", url[i], f'{{"data":[{",".join(data)}],"links":{{"next":{link}}}}}'))
        seen, todo = set(), [0]
        while todo:
            i = todo.pop()
            if i in seen or i >= count:
                continue
            seen.add(i)
            todo += folders.get(i, []) + ([following[i]] if i in following else [])
        frame = spark.createDataFrame(pages, "source_id string, page_url string, body string")
        roots = spark.createDataFrame([("s", url[0])], "source_id string, page_url string")
        got = sorted(r["relative_path"] for r in listings.osf_manifest(frame, roots).collect())
        assert got == sorted(f"f{i}" for i in seen)


def listings_url(i: int) -> str:
    return f"https://api.osf.io/p{i}/?page%5Bsize%5D=100"


def test_name_search_without_pairs(spark):
    names = ["THINGS-MEG", "things_b", "Alpha 100%", "ab", "x", "Ünï code"]
    datasets = spark.createDataFrame([(f"d{i}", n, T0 + dt.timedelta(minutes=i)) for i, n in enumerate(names)], "dataset_id string, name string, created_at timestamp")
    aliases = spark.createDataFrame([("d3", "name_alias", "Vision things")], "dataset_id string, kind string, value string")
    needles = ["THINGS_MEG", "things", "ab", "%", "_", "vision", "a%b", "ÜNÏ", "nope", "b\\c", "x"]
    frame = spark.createDataFrame([(str(i), n) for i, n in enumerate(needles)], "request_id string, needle string")
    got = {r["needle"]: r["match_count"] for r in search.search_by_name(frame, datasets, aliases).collect()}
    assert got == {"THINGS_MEG": 1, "things": 3, "ab": 1, "%": 6, "_": 6, "vision": 1, "a%b": 1, "ÜNÏ": 1, "nope": 0, "b\\c": 0, "x": 1}


def test_url_matches_count_each_dataset_once(spark):
    schema = "dataset_id string, name string, source_url string, status string, created_at timestamp"
    datasets = spark.createDataFrame([(f"d{i:03d}", f"n{i}", f"https://openneuro.org/datasets/ds{i}", "available", T0 + dt.timedelta(minutes=i)) for i in range(90)], schema)
    aliases = spark.createDataFrame([
        ("d001", "url", "https://openneuro.org/datasets/again"), ("d002", "path", "https://openneuro.org/datasets/ds2"),
        ("d003", "path", "https://elsewhere.org/x/y"),
    ], "dataset_id string, kind string, value string")
    requests = spark.createDataFrame([("1", "https://openneuro.org/datasets/whatever"), ("2", "https://openneuro.org/datasets/ds2"),
                                      ("3", "https://elsewhere.org/x/y"), ("4", "https://elsewhere.org/x/z"), ("5", None)], "request_id string, url string")
    got = {r["request_id"]: (r["match_count"], r["newest_dataset_id"]) for r in search.match_urls(requests, datasets, aliases).collect()}
    assert got == {"1": (90, "d089"), "2": (90, "d089"), "3": (1, "d003"), "4": (0, None), "5": (0, None)}


def test_no_hot_key_reaches_one_task(spark):
    """Ranks that are filtered to a few rows must be limited before the shuffle."""
    frame = spark.range(10).select(
        (F.col("id") % 2).cast("string").alias("dataset_id"), F.col("id").cast("string").alias("check_id"), F.timestamp_seconds("id").alias("started_at")
    )
    from shelfmark.operators.health import latest_health

    plan = latest_health(frame)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit .*Partial", plan)
