"""Small literal cases of the catalog's rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shelfmark.functions import paths, text, urls, values
from shelfmark.operators import conflicts, failures, health, intake, inventory, manifests, ranking, search, sources
from shelfmark.sources import listings, logs, registry

T0 = dt.datetime(2024, 1, 1)
DATASETS = (
    "dataset_id string, name string, provider string, source_url string, version string, modalities array<string>, "
    "size_bytes bigint, size_bytes_known boolean, status string, storage_path string, storage_mode string, created_at timestamp"
)
ALIASES = "dataset_id string, kind string, value string"
INVENTORY = (
    "dataset_id string, relative_path string, kind string, target_kind string, dev bigint, ino bigint, size bigint, "
    "mode int, uid bigint, is_dangling boolean, content_present boolean, checksum string"
)


def dataset(dataset_id, name, url=None, provider="openneuro", version="3.0.0", modalities=("meg",), status="available",
            path="/data/x", mode="reference", minutes=0, size=29, known=True):
    return (dataset_id, name, provider, url, version, list(modalities), size, known, status, path, mode, T0 + dt.timedelta(minutes=minutes))


def column(spark, build, rows, name="v"):
    frame = spark.createDataFrame([(row,) for row in rows], f"{name} string")
    return [row[0] for row in frame.select(build(F.col(name))).collect()]


def on_urls(spark, build, rows):
    frame = urls.with_parts(spark.createDataFrame([(row,) for row in rows], "url string"), F.col("url"))
    return [row[0] for row in frame.select(build(F.col("_u"))).collect()]


def test_providers(spark):
    cases = {
        "https://www.synapse.org/Synapse:syn7": "synapse",
        "https://zenodo.org/records/42": "zenodo",
        "https://zenodo.org/records/fortytwo": "other",
        "https://zenodo.org/communities/cells/": "other",
        "https://zenodo.org/": "other",
        "https://doi.org/10.5281/zenodo.42": "zenodo",
        "https://osf.io/ab3de/": "osf",
        "https://osf.io/projects/": "other",
        "https://www.kaggle.com/datasets/someone/waves": "kaggle",
        "https://neurovault.org/collections/9/": "neurovault",
        "https://physionet.org/content/waves/2.1/": "physionet",
        "https://fakeopenneuro.org/datasets/ds000009": "other",
    }
    assert on_urls(spark, urls.provider, list(cases)) == list(cases.values())


def test_identity_keys(spark):
    cases = {
        "https://OSF.io:443/pq7vb/?download=1#files": "https|osf.io||pq7vb",
        "http://h:8080//a/b": "http|h|8080|a",
        "https://h:99999/x": None, "file:///x": None, "https://h/": None, "plain": None,
        "HTTPS://u:p@H.org/Keep": "https|h.org||Keep",
    }
    assert on_urls(spark, urls.identity_key, list(cases)) == list(cases.values())


def test_versions(spark):
    frame = spark.createDataFrame([
        ("given", "https://physionet.org/content/waves/2.1.4/", "latest"),
        ("read", "https://physionet.org/content/waves/2.1.4/", None),
        ("absent", "https://physionet.org/content/waves/", None),
        ("snapshot", "https://openneuro.org/datasets/ds000009/versions/4.0.2", None),
        ("other host", "https://dandiarchive.org/dandiset/000777/0.2", None),
        ("empty", "https://physionet.org/content/waves/2.1.4/", "\u3000"),
    ], "request_id string, url string, requested_version string")
    got = {r["request_id"]: (r["version"], r["problem"]) for r in sources.infer_url_versions(frame).collect()}
    assert got == {
        "given": ("latest", None), "read": ("2.1.4", None), "absent": (None, "version is required"),
        "snapshot": ("4.0.2", None), "other host": (None, "version is required"), "empty": (None, "version is blank"),
    }


def test_provider_ids(spark):
    rows = ["AG3KJ", "bad/id", "ftp://osf.io/abcde", "583331", "https://zenodo.org/record/583331", "ds005261",
            "https://openneuro.org/datasets/ds005261/versions/2.0.0", "005261", "dsABC",
            "https://openneuro.org/datasets/ds005261/files", "https://openneuro.org/datasets/ds005261/versions/bad/tag"]
    frame = spark.createDataFrame([(str(i), row) for i, row in enumerate(rows)], "request_id string, url string")
    got = {r["request_id"]: r for r in sources.extract_provider_ids(frame).collect()}
    assert got["0"]["osf_id"] == "ag3kj" and got["1"]["osf_id"] is None and got["2"]["osf_problem"] == "not an http url"
    assert got["3"]["zenodo_id"] == "583331" and got["4"]["zenodo_id"] == "583331"
    assert got["5"]["openneuro_id"] == "ds005261"
    assert (got["6"]["openneuro_id"], got["6"]["openneuro_version"]) == ("ds005261", "2.0.0")
    assert all(got[str(i)]["openneuro_id"] is None for i in (7, 8, 9, 10))


def test_mirror_and_api_base(spark):
    def source(mirror):
        return column(spark, lambda c: urls.mirror_source(mirror, c), ["ds1"])[0]

    assert source("https://m.example/{dataset_id}/x") == "https://m.example/ds1/x"
    assert source("https://m.example/repo.git") == "https://m.example/repo.git"
    assert source("https://m.example/base/") == "https://m.example/base/ds1.git"
    assert column(spark, urls.normalized_api_base, ["https://z.org/", "https://z.org/api"]) == ["https://z.org/api"] * 2


def test_slug_and_modes(spark):
    assert column(spark, paths.slug, ["..My Set!! v1--", "@@", "Keep_1.2"]) == ["my-set-v1", "dataset", "keep_1.2"]
    rows = [("dir", 0o740), ("dir", 0o710), ("file", 0o640), ("file", 0o750), ("symlink", 0o777)]
    frame = spark.createDataFrame(rows, "kind string, mode int")
    got = frame.select(paths.public_mode(F.col("kind"), F.col("mode")), paths.managed_mode(F.col("kind"), F.col("mode"))).collect()
    assert [r[0] for r in got] == [0o745, 0o715, 0o644, 0o754, None]
    assert [r[1] for r in got] == [0o755, 0o755, 0o644, 0o755, None]


def test_redaction(spark):
    cases = {
        "reset at https://cdn.example/file?token=hidden": "reset at https://cdn.example/file<redacted>",
        "Bearer abc.def, next": "Bearer <redacted>, next",
        "see https://U:p@CDN.Example/data.bin?X=1#f.": "see https://cdn.example/data.bin",
        "http://h:70000/x and http://h:0080/y": "<redacted-url> and http://h:80/y",
        "API-key: 42; password=x,token = y": "API-key: <redacted>; password=<redacted>,token = <redacted>",
        "nothing here": "nothing here", "HTTPS://X.org/a?b": "HTTPS://X.org/a?b",
    }
    # The assignment rule runs first, so the URL ends at the mask it leaves.
    assert column(spark, text.redact, list(cases)) == list(cases.values())
    assert column(spark, lambda c: text.redact(c, bearer_first=True), ["Authorization: Bearer abc"]) == ["Authorization: <redacted> <redacted>"]
    assert column(spark, text.redact, ["Authorization: Bearer abc"]) == ["Authorization: <redacted> abc"]


def test_event_fields(spark):
    line = '2024-01-01T00:00:01Z INFO request_failed authorization=Bearer super-secret cookie=session=hidden url=https://cdn.example/data.bin?X=1'
    rows = logs.redacted_events(spark.createDataFrame([("a.log", line), ("a.log", "  File x, line 1")], "source string, line string")).collect()
    assert rows[0]["content"] == "authorization=<redacted> cookie=<redacted> url=https://cdn.example/data.bin"
    assert rows[1]["level"] is None and rows[1]["content"] == "  File x, line 1"


def test_size_labels(spark):
    frame = spark.createDataFrame([(12,), (1536,), (5 * 1024**5,), (None,), (47360,)], "n bigint")
    assert [r[0] for r in frame.select(text.size_label(F.col("n"))).collect()] == ["12 B", "1.5 KB", "5.0 PB", "-", "46.2 KB"]


def test_modalities_and_aliases(spark):
    frame = spark.createDataFrame([([" EEG", "meg", "eeg"], [" A ", "b", "a", "Canon", "B "])], "m array<string>, a array<string>")
    row = frame.select(
        values.normalized_modalities(F.col("m")), values.unknown_modalities(F.array(F.lit("eeg"), F.lit("xray"))),
        values.normalized_aliases(F.col("a"), F.lit("canon")), values.merged_modalities(F.array(F.lit("meg"), F.lit("")), F.col("m")),
    ).first()
    assert list(row) == [["eeg", "meg"], ["xray"], ["A", "b"], ["eeg", "meg"]]


def registry_of(spark):
    datasets = spark.createDataFrame([
        dataset("root", "OSF ROOT", "https://osf.io/pq7vb/", "osf", minutes=1),
        dataset("nested", "OSF NESTED", "https://osf.io/pq7vb/files/osfstorage", "osf", minutes=2),
        dataset("other", "OSF OTHER", "https://osf.io/otherid/files", "osf", minutes=3),
        dataset("things", "THINGS-MEG", "https://openneuro.org/datasets/ds004212", minutes=4),
        dataset("gone", "Gone", "https://gone.example/x", "other", status="missing", modalities=("ieeg",), minutes=5),
    ], DATASETS)
    aliases = spark.createDataFrame([
        ("root", "url", "https://osf.io/aliasid/files"), ("root", "path", "/registered/local/path"),
        ("things", "name", "THINGS-MEG"), ("things", "name_alias", "THINGS"), ("things", "name_alias", "THINGS vision"),
    ], ALIASES)
    return datasets, aliases


def test_search(spark):
    datasets, aliases = registry_of(spark)

    def found(**filters):
        return [r["dataset_id"] for r in search.find_datasets(datasets, aliases, **filters).collect()]

    assert found() == ["things", "other", "nested", "root"]
    assert found(query="vision") == ["things"] and found(query="THINGS_MEG") == ["things"] and found(query="absent") == []
    assert found(modality="eeg") == [] and found(modality="eeg", show_all=True) == ["gone"]
    assert found(modality="eeg", show_all=True, exact_modality=True) == []
    assert found(provider="openneuro") == ["things"]
    assert found(url="https://osf.io/pq7vb/?download=1#files") == ["nested", "root"]
    assert found(url="https://osf.io/") == [] and found(url="https://osf.io/otherid/") == ["other"]
    assert found(url="https://osf.io/aliasid/") == ["root"] and found(url="/registered/local/path") == ["root"]
    assert found(url="/registered/local/path/child") == []


def test_resolve(spark):
    datasets, aliases = registry_of(spark)
    requests = spark.createDataFrame([
        ("1", "things", None, None), ("2", None, "things", None), ("3", None, None, "https://osf.io/pq7vb/"),
        ("4", "https://osf.io/otherid", None, None), ("5", "a", "b", None), ("6", "/registered/local/path", None, None),
        ("7", None, None, None), ("8", "nobody", None, None), ("9", "gone", None, None),
    ], "request_id string, identifier string, name string, url string")
    got = {r["request_id"]: (r["outcome"], r["dataset_id"]) for r in search.resolve_identifiers(requests, datasets, aliases).collect()}
    assert got == {
        "1": ("found", "things"), "2": ("found", "things"), "3": ("ambiguous", None), "4": ("found", "other"), "5": ("invalid", None),
        "6": ("found", "root"), "7": ("invalid", None), "8": ("not found", None), "9": ("found", "gone"),
    }


def test_conflicts(spark):
    datasets, aliases = registry_of(spark)
    requests = spark.createDataFrame([
        ("1", "things-meg", "file:///new", []), ("2", "New", "https://openneuro.org/datasets/ds004212", []),
        ("3", "things", "file:///n", []), ("4", "Fresh", "file:///f", ["x", "osf other"]), ("5", "Fresh", "file:///f", ["x"]),
    ], "request_id string, name string, source_reference string, aliases array<string>")
    got = {r["request_id"]: (r["outcome"], r["reason"], r["owner_id"]) for r in conflicts.identity_conflicts(requests, datasets, aliases).collect()}
    assert got == {
        "1": ("conflict", "name", "things"), "2": ("conflict", "source URL/path", "things"), "3": ("conflict", "name", "things"),
        "4": ("conflict", "name alias", "other"), "5": ("accepted", None, None),
    }


def test_updates(spark):
    datasets = spark.createDataFrame([
        dataset("a", "Update missing", "file:///data/a", "other", "unknown", ()), dataset("b", "THINGS-MEG", "https://openneuro.org/datasets/ds004212"),
        dataset("c", "Other", "file:///data/c", "other", "1"),
    ], DATASETS)
    aliases = spark.createDataFrame([("a", "path", "file:///data/a"), ("a", "name", "Update missing")], ALIASES)
    schema = "request_id string, identifier string, url string, provider string, version string, modalities array<string>, aliases array<string>, force boolean"

    def run(rows):
        change = intake.update_metadata(spark.createDataFrame(rows, schema), datasets, aliases)
        return {r["request_id"]: r["outcome"] for r in change.outcomes.collect()}, change

    outcomes, change = run([
        ("1", "a", "https://openneuro.org/datasets/ds009999", None, "1.0.0", ["meg", "eeg", "meg"], ["Update alias", "Update alias"], False),
        ("2", "b", None, None, "4.0.0", [], [], False),
        ("3", "b", "https://openneuro.org/datasets/ds000001", None, None, [], [], True),
        ("4", "no-such-id", None, None, "1", [], [], False),
        ("5", "c", "https://openneuro.org/datasets/ds004212", None, None, [], [], False),
        ("6", "a", None, None, None, [], [], False),
        ("7", "c", " ", None, None, [], [], False),
        ("8", "b", None, "dandi", "4.0.0", [], [], True),
        ("9", "b", None, None, None, ["eeg"], [], False),
        ("10", "c", None, None, None, [], ["update ALIAS"], False),
    ])
    assert outcomes == {
        "1": "accepted", "2": "rejected", "3": "rejected", "4": "not found", "5": "conflict", "6": "invalid", "7": "invalid",
        "8": "accepted", "9": "accepted", "10": "conflict",
    }
    rows = {r["dataset_id"]: r for r in change.datasets.collect()}
    assert (rows["a"]["provider"], rows["a"]["version"], rows["a"]["modalities"]) == ("openneuro", "1.0.0", ["eeg", "meg"])
    assert (rows["b"]["provider"], rows["b"]["version"], rows["b"]["modalities"]) == ("dandi", "4.0.0", ["eeg", "meg"])
    assert set(rows) == {"a", "b"}
    assert sorted((r["dataset_id"], r["kind"], r["value"]) for r in change.aliases.collect()) == [
        ("a", "name_alias", "Update alias"), ("a", "url", "https://openneuro.org/datasets/ds009999"),
    ]


def test_updates_that_only_add_take_one_round(spark, monkeypatch):
    datasets = spark.createDataFrame([dataset("b", "THINGS-MEG", "https://openneuro.org/datasets/ds004212")], DATASETS)
    aliases = spark.createDataFrame([("b", "name", "THINGS-MEG")], ALIASES)
    schema = "request_id string, identifier string, url string, provider string, version string, modalities array<string>, aliases array<string>, force boolean"
    adds = [(f"{k:03d}", "b", None, None, None, ["meg"] if k % 2 else [], [f"added {k % 30}"], False) for k in range(60)]
    rows = adds[:40] + [("040x", "b", None, "dandi", "9.0", [], ["with version"], True)] + adds[40:]
    rounds, turn = [], intake._update_turn
    monkeypatch.setattr(intake, "_update_turn", lambda *given: rounds.append(1) or turn(*given))
    change = intake.update_metadata(spark.createDataFrame(rows, schema), datasets, aliases)
    assert len(rounds) == 3  # those before the one that sets values, that one, those after it
    assert {r["outcome"] for r in change.outcomes.collect()} == {"accepted"} and change.outcomes.count() == 61
    (b,) = [r for r in change.datasets.collect() if r["dataset_id"] == "b"]
    assert (b["provider"], b["version"]) == ("dandi", "9.0") and "meg" in b["modalities"]
    assert sorted(r["value"] for r in change.aliases.collect()) == sorted({f"added {k}" for k in range(30)} | {"with version"})


def test_repairs_are_judged_by_the_inventories_before_and_after(spark):
    entry = "dataset_id string, relative_path string, kind string, target_kind string, dev bigint, ino bigint, size bigint, is_dangling boolean, content_present boolean, checksum string"

    def listing(*rows):
        made = [(d, p, k, "file" if k == "symlink" else None, 1, n, 5, False, present, None) for n, (d, p, k, present) in enumerate(rows)]
        return spark.createDataFrame(made, entry)

    base = [(d, p, "file", True) for d in "abc" for p in (".git/config", ".datalad/x", "sub/data")]
    missing = [("a", f"sub/f{k}", "symlink", False) for k in range(9)] + [("b", "sub/g", "symlink", False), ("c", "sub/h", "symlink", False)]
    later = [(d, p, k, p in ("sub/f0", "sub/h")) for d, p, k, _ in missing]
    before, after = listing(*base, *missing), listing(*reversed(base), *reversed(later))
    assert sorted(r["dataset_id"] for r in inventory.changed_datasets(before, after).collect()) == ["a", "c"]
    changes = sorted(tuple(r) for r in inventory.inventory_changes(before, listing(*base[1:], *later, ("c", "new", "file", True))).collect())
    assert changes == [("a", ".git/config", "removed"), ("a", "sub/f0", "changed"), ("c", "new", "added"), ("c", "sub/h", "changed")]
    datasets = spark.createDataFrame([(d, d, "missing", f"/r/{d}", 1, True) for d in "abcde"], (
        "dataset_id string, name string, status string, storage_path string, size_bytes bigint, size_bytes_known boolean"
    ))
    repairs = spark.createDataFrame([(d, True, 0, None, None) for d in "abc"], "dataset_id string, tool_present boolean, exit_code int, error string, recheck_error string")
    roots = spark.createDataFrame([("d", True), ("e", False)], "dataset_id string, is_directory boolean")
    tools = spark.createDataFrame([(d, True, None, None) for d in "abc"], "dataset_id string, tool_present boolean, error string, size_error string")
    evidence = inventory.repair_evidence(before, after, repairs)
    checks = {r["dataset_id"]: r for r in health.health_check(datasets, before, tools, evidence, roots).collect()}
    assert checks["a"]["message"].endswith("still absent after repair: sub/f1, sub/f2, sub/f3, sub/f4, sub/f5") and checks["a"]["result"] == "broken"
    assert checks["b"]["message"].endswith("still absent after repair: sub/g") and checks["c"]["result"] == "healthy"
    assert checks["d"]["message"].startswith("Dataset directory has no") and checks["e"]["message"].startswith("Dataset path does not exist")


def test_register_batch(spark):
    datasets, aliases = registry_of(spark)
    schema = (
        "request_id string, source string, name string, provider string, url string, version string, modalities array<string>, "
        "storage_mode string, aliases array<string>, size_bytes bigint, source_is_dir boolean, requested_at timestamp"
    )

    def request(number, name, url=None, version=None, aliases=(), mode="reference", size=5, is_dir=True, modalities=("MEG",)):
        return (f"r{number:02d}", f"/in/{number}", name, "other", url, version, list(modalities), mode, list(aliases), size, is_dir,
                T0 + dt.timedelta(days=1, minutes=number))

    change = intake.register_batch(spark.createDataFrame([
        request(1, " First ", aliases=["One", "one", "first"]), request(2, "FIRST"), request(3, "Third", aliases=["x", "ONE"]),
        request(4, "Fourth", url="https://openneuro.org/datasets/ds1/versions/1.0.1", mode="move", size=None),
        request(5, "Fifth", url="https://openneuro.org/datasets/ds1/versions/1.0.1"), request(6, "things-meg"), request(7, " "),
        request(8, "Eighth", size=-1), request(9, "Ninth", is_dir=False), request(10, "Tenth", modalities=["xray"]),
        request(11, "/registered/local/path"), request(12, "Third"),
    ], schema), datasets, aliases)
    got = {r["request_id"]: (r["outcome"], r["reason"]) for r in change.outcomes.collect()}
    assert got == {
        "r01": ("accepted", None), "r02": ("conflict", "name"), "r03": ("conflict", "name alias"), "r04": ("accepted", None),
        "r05": ("conflict", "source URL/path"), "r06": ("conflict", "name"), "r07": ("invalid", "name is blank"), "r08": ("failed", "size is negative"),
        "r09": ("failed", "source is not a directory"), "r10": ("invalid", "unknown modality"), "r11": ("conflict", "stored value repeats"),
        "r12": ("accepted", None),
    }
    rows = {r["name"]: r for r in change.datasets.collect()}
    assert set(rows) == {"First", "Fourth", "Third"} and rows["First"]["storage_path"] == "/in/1" and rows["First"]["source_url"] == "file:///in/1"
    fourth = rows["Fourth"]
    assert (fourth["provider"], fourth["version"], fourth["size_bytes"], fourth["size_bytes_known"]) == ("openneuro", "1.0.1", 0, False)
    assert fourth["storage_path"] == f"/registry/datasets/fourth-1.0.1-{fourth['dataset_id']}"
    held = sorted((r["kind"], r["value"]) for r in change.aliases.collect() if r["dataset_id"] == rows["First"]["dataset_id"])
    assert held == [("name", "First"), ("name_alias", "One"), ("path", "file:///in/1")]
    problems = conflicts.constraint_violations(
        datasets.unionByName(change.datasets), aliases.unionByName(change.aliases), change.jobs,
        spark.createDataFrame([("root",)], "dataset_id string"),
    )
    assert problems.isEmpty()


def test_transitions(spark):
    datasets = spark.createDataFrame([dataset("a", "Set A"), dataset("b", "Set B", mode="move")], DATASETS)
    sizes = spark.createDataFrame([("a", 29)], "dataset_id string, total_bytes bigint")
    requests = spark.createDataFrame([
        ("1", "a", "move", True, False), ("2", "a", "copy", True, False), ("3", "x", "move", True, False), ("4", "a", "reference", True, False),
        ("5", "b", "copy", True, False),
    ], "request_id string, dataset_id string, mode string, path_is_dir boolean, destination_exists boolean")
    change = intake.storage_transitions(requests, datasets, sizes)
    assert {r["request_id"]: r["outcome"] for r in change.outcomes.collect()} == {"1": "ok", "2": "conflict", "3": "not found", "4": "invalid", "5": "conflict"}
    moved = change.datasets.first()
    assert (moved["storage_path"], moved["storage_mode"], moved["size_bytes"]) == ("/registry/datasets/set-a-3.0.0-a", "move", 29)


def test_allowed_sources(spark):
    frame = spark.createDataFrame([("1", "/lab/x", True), ("2", "/reg/incoming/y", True), ("3", "/reg/z", True), ("4", "/labx", True), ("5", "/lab", False)], "request_id string, source string, is_dir boolean")
    got = {r["request_id"]: r["accepted"] for r in intake.allowed_sources(frame, "/reg", "/reg/incoming", ["/lab"]).collect()}
    assert got == {"1": True, "2": True, "3": False, "4": False, "5": False}


def test_schema_upgrade(spark):
    old = spark.createDataFrame([("a", "Old", "other", "legacy-secret")], "dataset_id string, name string, provider string, retired string")
    row = registry.append_to_reconciled(registry.reconcile_schema(old, "datasets"), spark.createDataFrame([dataset("b", "New")], DATASETS)).orderBy("dataset_id").collect()
    assert (row[0]["version"], row[0]["storage_mode"], row[0]["size_bytes_known"], row[0]["retired"]) == ("unknown", "reference", True, "legacy-secret")
    assert row[1]["retired"] is None
    bad = spark.createDataFrame([("a", "n")], "dataset_id string, kind string")
    try:
        registry.reconcile_schema(bad, "dataset_aliases")
        raise AssertionError("must be refused")
    except registry.SchemaUpgradeError:
        pass
    assert "value" in registry.reconcile_schema(bad.limit(0), "dataset_aliases").columns


def test_transfer_plan(spark):
    manifest = spark.createDataFrame([
        ("s", "done.bin", 3, None), ("s", "wrong.bin", 4, None), ("s", "part.bin", 6, None), ("s", "link.bin", 3, None),
        ("s", "full.bin", 3, "md5:a"), ("s", "corrupt.bin", 3, "md5:a"), ("s", "long.bin", 3, None), ("s", "new.bin", 3, None),
    ], "source_id string, relative_path string, size bigint, checksum string")
    files = spark.createDataFrame([
        ("s", "done.bin", "file", 3, None), ("s", "wrong.bin", "file", 3, None), ("s", "part.bin.part", "file", 3, None),
        ("s", "link.bin.part", "symlink", 3, None), ("s", "full.bin.part", "file", 3, "md5:a"), ("s", "corrupt.bin.part", "file", 3, "md5:b"),
        ("s", "long.bin.part", "file", 9, None),
    ], "source_id string, relative_path string, kind string, size bigint, checksum string")
    got = {r["relative_path"]: (r["action"], r["offset"]) for r in manifests.transfer_plan(manifest, files).collect()}
    assert got == {
        "done.bin": ("skip", None), "wrong.bin": ("conflict", None), "part.bin": ("resume", 3), "link.bin": ("reject_partial", None),
        "full.bin": ("publish", None), "corrupt.bin": ("partial_corrupt", None), "long.bin": ("partial_too_large", None), "new.bin": ("download", 0),
    }


def test_zenodo_layouts(spark):
    records = spark.createDataFrame([
        ("new", '{"files":[{"key":"a.bin","size":3,"checksum":"md5:x","links":{"content":"https://z/a"}}]}'),
        ("old", '{"files":{"entries":{"README":{"filename":"README","size":2,"links":{"self":"https://z/r"}}}}}'),
    ], "source_id string, body string")
    got = sorted(tuple(r) for r in listings.zenodo_manifest(records).collect())
    assert got == [("new", "a.bin", 3, "https://z/a", "md5:x"), ("old", "README", 2, "https://z/r", None)]


def entry(dataset_id, path, kind="file", ino=1, size=13, target=None, dangling=False, present=True):
    return (dataset_id, path, kind, target, 1, ino, size, 0o644, 0, dangling, present, None)


def test_sizes_and_markers(spark):
    files = spark.createDataFrame([
        entry("a", ".git/annex/objects/payload.bin", ino=1), entry("a", "visible.bin", "symlink", 1, 13, "file"),
        entry("a", "second.bin", ino=2), entry("a", "broken.bin", "symlink", 3, 5, None, True, False),
        entry("b", ".git/annex", "dir", 9, 0),
    ], INVENTORY)
    assert {r["dataset_id"]: r["total_bytes"] for r in inventory.dataset_sizes(files).collect()} == {"a": 26, "b": 0}
    marks = {r["dataset_id"]: (r["has_payload"], r["is_checkout"]) for r in inventory.payload_markers(files).collect()}
    assert marks == {"a": (True, True), "b": (False, True)}
    assert [tuple(r) for r in inventory.missing_content(files).collect()] == [("a", "broken.bin")]


def test_health(spark):
    datasets = spark.createDataFrame([
        dataset("gone", "Gone"), dataset("plain", "Plain", status="quarantined"), dataset("back", "Back", status="missing"),
        dataset("annex", "Annex"), dataset("tool", "Tool"), dataset("nopath", "NoPath", path=None), dataset("size", "Size", size=123),
    ], DATASETS)
    files = spark.createDataFrame([
        entry("plain", "a.bin"), entry("back", "a.bin"), entry("size", "a.bin"),
        entry("annex", ".git/annex/x", ino=4), entry("annex", "m.fif", "symlink", 5, 1, None, True, False),
        entry("tool", ".git/annex/x"), entry("tool", "m.fif"),
    ], INVENTORY)
    inspections = spark.createDataFrame([("tool", True, "exit status 128", None), ("size", True, None, "Permission denied")], "dataset_id string, tool_present boolean, error string, size_error string")

    def checks(repairs=None):
        return {r["dataset_id"]: r for r in health.health_check(datasets, files, inspections, repairs).collect()}

    got = checks()
    assert {k: (v["result"], v["resulting_status"]) for k, v in got.items()} == {
        "gone": ("missing", "missing"), "plain": ("healthy", "quarantined"), "back": ("healthy", "available"), "annex": ("broken", "broken"),
        "tool": ("error", "available"), "nopath": ("missing", "missing"), "size": ("error", "available"),
    }
    assert got["plain"]["size_bytes"] == 13 and got["size"]["size_bytes"] == 123
    assert got["annex"]["message"] == "Annexed content is not present locally: m.fif"
    schema = "dataset_id string, tool_present boolean, exit_code int, error string, missing_after bigint, recheck_error string"
    fixed = checks(spark.createDataFrame([("annex", True, 0, None, 0, None)], schema))["annex"]
    assert (fixed["result"], fixed["resulting_status"], fixed["repair_attempted"], fixed["repair_succeeded"]) == ("healthy", "available", True, True)
    failed = checks(spark.createDataFrame([("annex", True, 1, "no network", None, None)], schema))["annex"]
    assert (failed["result"], failed["repair_attempted"], failed["repair_succeeded"]) == ("broken", True, False)
    untried = checks(spark.createDataFrame([("annex", False, None, None, None, None)], schema))["annex"]
    assert (untried["result"], untried["repair_attempted"], untried["repair_succeeded"]) == ("broken", False, None)


CHAIN = "array<struct<type: string, message: string, http_status: int, retry_after: string>>"


def test_failure_classes(spark):
    def link(kind="RuntimeError", message="", status=None, after=None):
        return (kind, message, status, after)

    cases = [([link(status=code)], "http", "terminal") for code in (401, 403, 404, 407)]
    cases += [([link(status=code)], "http", "network") for code in (408, 425)]
    cases += [([link(status=429, after="7")], "http", "rate_limit"), ([link(status=500)], "http", "server"), ([link(status=599)], "http", "server")]
    cases += [([link(message="407 Proxy Authentication Required"), link("ConnectionResetError")], "http", "terminal"), ([link(message="no space left on device")], "http", "terminal")]
    cases += [([link(kind)], "git", "network") for kind in ("ConnectionResetError", "ReadError", "gaierror", "SSLError", "TimeoutError", "IncompleteRead", "MaxRetryError", "DryRunError")]
    cases += [([link(message="Connection RESET")], "http", "network"), ([link(message="Connection RESET")], "git", "terminal"),
              ([link("PermissionError", "network share")], "http", "terminal"), ([link("MihomoUnavailableError")], "http", "mihomo")]
    frame = spark.createDataFrame([(str(i), 1, transport, chain) for i, (chain, transport, _) in enumerate(cases)],
                                  f"operation string, attempt int, transport string, chain {CHAIN}")
    got = {int(r["operation"]): r for r in failures.classify_failures(frame, "2024-01-31 00:00:00").collect()}
    assert [got[i]["category"] for i in range(len(cases))] == [case[2] for case in cases]
    assert got[6]["retry_after"] == 7.0 and not got[6]["rotate_node"]


def test_retry_schedule(spark):
    frame = spark.createDataFrame([("o", i, 8, True, None) for i in range(1, 9)] + [("p", 2, 0, True, 500.0), ("q", 1, 8, False, None)],
                                  "operation string, attempt int, attempt_limit int, retryable boolean, retry_after double")
    got = {(r["operation"], r["attempt"]): (r["action"], r["delay_seconds"]) for r in failures.retry_schedule(frame).collect()}
    assert [got[("o", i)][1] for i in range(1, 8)] == [5, 10, 20, 40, 80, 160, 300]
    assert got[("o", 8)] == ("give_up", None) and got[("p", 2)] == ("retry", 500.0) and got[("q", 1)] == ("fail_now", None)


def test_retry_after_dates(spark):
    frame = spark.createDataFrame([("Wed, 31 Jan 2024 00:01:00 GMT",), ("-3",), ("1.5",), ("soon",), ("Wed, 31 Jan 2023 00:01:00 GMT",)], "v string")
    assert [r[0] for r in frame.select(failures.retry_after_seconds(F.col("v"), "2024-01-31 00:00:00")).collect()] == [60.0, 0.0, 1.5, None, 0.0]


def test_node_ranking(spark):
    def probes(node, order, latencies, speeds):
        rows = [(node, order, "latency", v is not None, v) for v in latencies]
        return rows + [(node, order, "throughput", v is not None, v) for v in speeds]

    stable = probes("stable", 0, [100.0, 110.0, 120.0], [2.0, 2.1])
    flaky = probes("flaky", 1, [100.0, 110.0, 120.0], [20.0, None])
    frame = spark.createDataFrame(stable + flaky, "node string, node_order bigint, phase string, ok boolean, value double")
    ranked = ranking.rank_nodes(ranking.latency_profiles(frame), ranking.node_scores(frame)).orderBy("rank").collect()
    assert [r["node"] for r in ranked] == ["stable", "flaky"] and ranked[0]["p95_latency"] == 120.0


def test_eligible_nodes(spark):
    frame = spark.createDataFrame([
        ("G", "Selector", ["stable-0.1倍", "other", "auto-0.1倍"]), ("auto-0.1倍", "URLTest", ["x"]), ("stable-0.1倍", "Shadowsocks", []), ("other", "Vmess", []),
    ], "name string, type string, members array<string>")

    def nodes(marker):
        return sorted(r["node"] for r in ranking.eligible_nodes(frame, marker).filter("group = 'G' and node is not null").collect())

    assert nodes("0.1倍") == ["stable-0.1倍"] and nodes("") == ["other", "stable-0.1倍"]


def test_retry_after_dates_and_numbers(spark):
    from shelfmark.operators.failures import retry_after_seconds

    cases = {
        "Wed, 31 Jan 2024 02:10:00 +0200": 600.0, "Wed, 31 Jan 2024 00:10:00 +0200": 0.0, "Wed, 31 Jan 2024 00:10 GMT": 600.0,
        "Wednesday, 31-Jan-24 00:10:00 GMT": 600.0, "31 Jan 2024 00:10:00": 600.0, "5d": None, "nan": 0.0, " 7.5 ": 7.5, "-3": 0.0,
        "soon": None, "": None,
    }
    assert column(spark, lambda v: retry_after_seconds(v, "2024-01-31 00:00:00"), list(cases)) == list(cases.values())


def test_blank_is_more_than_spaces(spark):
    from shelfmark.functions.values import strip

    assert column(spark, strip, ["\u3000", "\u2003x\u2028", "\n\n", " a b\t"]) == ["", "x", "", "a b"]


def test_command_output_loses_its_line_ends(spark):
    from shelfmark.operators.failures import classify_command_output

    rows = spark.createDataFrame([("a", "tool", 1, "\n\n"), ("b", "tool", 2, "  \n boom\n")], "run_id string, command string, exit_code int, output string")
    got = {r["run_id"]: (r["detail"], r["command_text"]) for r in classify_command_output(rows).collect()}
    assert got == {
        "a": ("tool exited with status 1: command produced no diagnostic output", "exit status 1"),
        "b": ("tool exited with status 2: boom", "boom"),
    }


def test_a_dataset_of_links_only_has_size_zero(spark):
    from shelfmark.operators.inventory import dataset_sizes

    rows = [("d", "x", "symlink", None, True, 1, 1, 9), ("e", "y", "file", None, False, 1, 2, 5), ("e", "z", "file", None, False, 1, 2, 5)]
    frame = spark.createDataFrame(rows, "dataset_id string, relative_path string, kind string, target_kind string, is_dangling boolean, dev bigint, ino bigint, size bigint")
    assert {tuple(r) for r in dataset_sizes(frame).collect()} == {("d", 0, 0), ("e", 5, 1)}


def test_text_and_negative_sizes_are_refused(spark):
    from shelfmark.sources.listings import hub_listing, zenodo_manifest

    body = '[{"filename":"a","file_size":"12","will_download":true},{"filename":"b","file_size":-3,"will_download":true},{"filename":"c","file_size":4,"will_download":true}]'
    frame = spark.createDataFrame([("s", body)], "source_id string, body string")
    assert {(r["relative_path"], r["size"], r["problem"]) for r in hub_listing(frame).collect()} == {
        ("a", None, "bad size"), ("b", -3, "bad size"), ("c", 4, None)
    }
    record = spark.createDataFrame([("s", '{"files":[{"key":"a","size":"12"},{"key":"b","size":7},{"key":"c","size":true}]}')], "source_id string, body string")
    assert {(r["relative_path"], r["size"]) for r in zenodo_manifest(record).collect()} == {("a", None), ("b", 7), ("c", None)}


def test_machine_local_work_folder_is_refused_on_a_cluster():
    import pytest

    from shelfmark.session import check_shared

    check_shared("file:/tmp/x", "local[8]")
    check_shared("hdfs://host/x", "yarn")
    for folder in ("file:/tmp/x", "/tmp/x"):
        with pytest.raises(ValueError):
            check_shared(folder, "spark://host:7077")


def test_retry_dates_of_all_spellings(spark):
    from email.utils import parsedate_to_datetime

    now = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
    texts = [
        "Wed, 31 Jan 2024 00:10:00 GMT", "Wed Jan 31 00:10:00 2024", "Wed Jan  3 00:10:00 2024", "31 Jan 2024 00:10:00 EST", "Thu, 01 Feb 2024 03:00:00 PDT",
        "1 Feb 2024 03:00 ADT", "31 Jan 24 00:10:00 XYZ", "Wed, 31 Jan 2024 00:10:00 +0100", "Wed, 31 Jan 2024 02:10:00 -0330", "31-Jan-2024 00:10:00 utc",
    ]
    plain = {"inf": float("inf"), "-inf": 0.0, "Infinity": float("inf"), "nan": 0.0, "7.5": 7.5, "-3": 0.0, "soon": None, "": None}
    rows = spark.createDataFrame([(t,) for t in [*texts, *plain]], "t string").select(
        "t", failures.retry_after_seconds(F.col("t"), "2024-01-31 00:00:00").alias("s")
    )
    got = {r["t"]: r["s"] for r in rows.collect()}
    for text in texts:
        at = parsedate_to_datetime(text)
        at = at.replace(tzinfo=dt.timezone.utc) if at.tzinfo is None else at
        assert got[text] == max(0.0, (at - now).total_seconds()), text
    assert {t: got[t] for t in plain} == plain


def test_benchmark_of_groups(spark):
    def node(k):
        return f"n{k}-cheap"

    proxies = spark.createDataFrame([
        ("g", "Selector", [node(k) for k in range(1, 7)] + ["dear", "h"]), ("h", "URLTest", [node(1)]), ("rest", "Selector", [node(9)]),
        ("deaf", "Selector", [node(7)]), ("mute", "Selector", [node(8)]), ("none", "Selector", ["dear"]),
        *[(node(k), "Shadowsocks", None) for k in range(1, 10)], ("dear", "Shadowsocks", None),
    ], "name string, type string, members array<string>")
    probes = [(node(2), "latency", True, 30.0), (node(2), "latency", False, 0.0), (node(3), "latency", False, 0.0), (node(8), "latency", True, 5.0)]
    probes += [(node(k), "real_latency", k != 4, 10.0 * k) for k in (1, 3, 4, 5, 6)]
    events = spark.createDataFrame([(n, 0, *rest) for n, *rest in probes], "node string, node_order bigint, phase string, ok boolean, value double")
    cooldowns = spark.createDataFrame([(node(1), False), (node(9), False), (node(2), True)], "node string, available boolean")
    chunks = spark.createDataFrame([
        (node(2), "a", 1, 300_000, 1.0), (node(2), "a", 2, 300_000, 2.0), (node(2), "a", 3, 300_000, 9.0),  # the third lies beyond the limit
        (node(3), "b", 1, 524_288, 1.0), (node(5), "c", 1, 0, 1.0), (node(6), "d", 1, 524_288, 0.1), (node(8), "e", 1, 10, 0.0),
    ], "node string, sample_id string, chunk_no bigint, bytes bigint, seconds double")
    rows = ranking.benchmark_groups(proxies, "-cheap", cooldowns, events, chunks).collect()
    ranked = {(r["group"], r["rank"]): (r["node"], round(r["median_throughput"], 3)) for r in rows if r["rank"]}
    # Node 1 rests, node 4 failed its real probe, nodes 3 and 5 fill up, node 6 comes too late, node 5 gives no bytes.
    assert ranked == {("g", 1): (node(3), 0.5), ("g", 2): (node(2), 0.25)}
    assert {r["group"]: r["problem"] for r in rows if not r["rank"]} == {
        "h": "not a selector", "none": "no direct node", "rest": "all nodes rest", "deaf": "no node passed the probes", "mute": "no node passed a speed test",
    }
