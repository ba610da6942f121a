"""Problems of provider listings as rows, readers that lose nothing beside a bad entry, and verdicts."""

from __future__ import annotations

import json

import pytest

from shelfmark.operators import manifests
from shelfmark.sources import listing_problems as found

URL = "https://pages.example/p%d?page%%5Bsize%%5D=100"


def file_entry(name, **attributes):
    return {"attributes": {"kind": "file", "materialized_path": f"/{name}", "size": 3, **attributes}, "links": {"download": f"https://d.example/{name}"}}


def folder_entry(related):
    return {"attributes": {"kind": "folder"}, "relationships": {"files": {"links": {"related": related}}}}


def page(data, following=None, **more):
    return json.dumps({"data": data, "links": {"next": following}, **more})


@pytest.fixture(scope="module")
def osf(spark):
    odd = [
        file_entry("x"), 5, {"attributes": 3}, {"attributes": {"kind": "link"}}, {"attributes": {"kind": "folder"}},
        folder_entry("https://pages.example/p2"), folder_entry({"href": "https://pages.example/p9"}), {"attributes": {"kind": "file"}},
    ]
    rows = [
        ("a", 1, page(odd, URL % 3)), ("a", 2, page([file_entry("deep/y")], URL % 4)), ("a", 3, '{"data": 5}'), ("a", 8, page([file_entry("z")])),
        ("b", 1, page([], URL % 2)), ("b", 2, page([], 7)), ("c", 1, None), ("e", 1, page([file_entry("ok")])),
        ("g", 1, json.dumps({"data": [file_entry("ok")], "links": [1]})), ("h", 1, json.dumps({"data": [file_entry("../ok")], "links": None})),
        ("i", 1, page([folder_entry("https://pages.example/p1"), file_entry("loop")], URL % 1)), ("j", 1, page([file_entry("t", size=True)])),
        ("k", 1, page([file_entry("same"), file_entry("/same")])),
    ]
    pages = spark.createDataFrame([(s, URL % n, b) for s, n, b in rows], "source_id string, page_url string, body string")
    roots = spark.createDataFrame([(s, URL % 1) for s in "abcdeghijk"], "source_id string, page_url string")
    return found.read_osf(pages, roots)


def test_a_bad_entry_takes_nothing_with_it(osf):
    rows = {(r["source_id"], r["relative_path"]) for r in osf[0].collect()}
    assert {("a", "x"), ("a", "deep/y"), ("g", "ok"), ("h", "../ok"), ("i", "loop")} <= rows and ("a", "z") not in rows


def test_osf_problems(osf):
    number = lambda place: place and int(place.split("/p")[-1].split("?")[0])
    rows = {(r["source_id"], number(r["place"]), r["entry"], r["problem"]) for r in osf[1].collect()}
    assert rows == {
        ("a", 1, 1, "entry is no object"), ("a", 1, 2, "entry has no attributes"), ("a", 1, 3, "entry is neither file nor folder"),
        ("a", 1, 4, "folder has no address"), ("a", 1, 7, "file has no links"), ("a", 1, None, "folder page is not stored"),
        ("a", 2, None, "next page is not stored"), ("a", 3, None, "data is no list"), ("a", 8, None, "stored page is not reachable"),
        ("b", 2, None, "next page is no address"), ("b", None, None, "listing has no files"),
        ("c", 1, None, "page is no object"), ("c", None, None, "listing has no files"),
        ("d", 1, None, "first page is not stored"), ("d", None, None, "listing has no files"), ("g", 1, None, "links are no object"),
    }


def test_osf_verdicts(osf):
    rows = {r["source_id"]: r for r in osf[2].collect()}
    assert {s for s, r in rows.items() if r["usable"]} == {"e", "i"} and len(rows) == 10
    assert (rows["a"]["problems"], rows["a"]["notes"], rows["a"]["first_problem"]) == (8, 1, "folder page is not stored")
    assert (rows["h"]["problems"], rows["h"]["rejected"]) == (0, 1) and rows["k"]["rejected"] == 2 and rows["j"]["rejected"] == 1
    assert (rows["d"]["files"], rows["d"]["bytes"], rows["e"]["bytes"]) == (0, 0, 3)


def test_plans_come_from_usable_listings_only(spark, osf):
    manifest, _, verdicts = osf
    usable = found.usable_manifest(manifest, verdicts)
    assert sorted(r["relative_path"] for r in usable.collect()) == ["loop", "ok"]
    files = spark.createDataFrame([("e", "ok", "file", 3, None)], "source_id string, relative_path string, kind string, size bigint, checksum string")
    assert [(r["source_id"], r["relative_path"]) for r in manifests.pending_files(usable, files).collect()] == [("i", "loop")]
    actions = {r["source_id"]: (r["action"], r["pending"]) for r in found.listing_outcomes(manifest, verdicts, files).collect()}
    assert actions.pop("e") == ("complete", 0) and actions.pop("i") == ("transfer", 1)
    assert set(actions.values()) == {("reject", 0)}


def test_zenodo(spark):
    link = '"links":{"self":"https://a.example/b"}'
    bodies = {
        "a": '{"files":[{"key":"k","size":1,%s}]}' % link,
        "b": '{"files":{"entries":{"z":{"filename":"k","size":1,%s},"a":7,"b":{"size":2}}}}' % link,
        "c": '{"files":{"entries":4}}', "d": '{"files":3}', "e": "[]", "f": None, "g": '{"files":[]}', "h": '{"files":{"entries":{}}}', "i": "{",
    }
    records = spark.createDataFrame(list(bodies.items()), "source_id string, body string")
    manifest, problems, verdicts = found.read_zenodo(records)
    assert {(r["source_id"], r["relative_path"]) for r in manifest.collect()} == {("a", "k"), ("b", "k"), ("b", None)}
    assert {(r["source_id"], r["entry"], r["problem"]) for r in problems.collect()} == {
        ("b", 0, "file is no object"), ("b", 1, "file has no links"), ("c", None, "entries are no object"),
        ("d", None, "files are neither list nor object"), ("e", None, "record is no object"), ("f", None, "record is no object"),
        ("g", None, "listing has no files"), ("h", None, "listing has no files"), ("i", None, "record is no object"),
    }
    assert {r["source_id"] for r in verdicts.collect() if r["usable"]} == {"a"}


def test_hub(spark):
    bodies = {
        "a": '[{"filename":"k","file_size":1,"will_download":true},{"filename":"l","file_size":true,"will_download":true},'
             '{"filename":"m","file_size":-1,"will_download":false},3]',
        "b": "{}", "c": "[]", "d": None,
    }
    pending, problems, verdicts = found.read_hub(spark.createDataFrame(list(bodies.items()), "source_id string, body string"))
    assert {(r["relative_path"], r["size"], r["problem"]) for r in pending.collect()} == {("k", 1, None), ("l", None, "bad size")}
    assert {(r["source_id"], r["entry"], r["problem"]) for r in problems.collect()} == {
        ("a", 1, "bad size"), ("a", 3, "record is no object"), ("b", None, "listing is no list"), ("d", None, "listing is no list"),
    }
    assert {r["source_id"]: r["usable"] for r in verdicts.collect()} == {"a": False, "b": False, "c": True, "d": False}


def test_empty_tables(spark, osf):
    pages = spark.createDataFrame([], "source_id string, page_url string, body string")
    roots = spark.createDataFrame([], "source_id string, page_url string")
    assert [df.count() for df in found.read_osf(pages, roots)] == [0, 0, 0]
    assert [df.count() for df in found.read_zenodo(pages.drop("page_url"))] == [0, 0, 0]


def test_pages_are_walked_once_for_manifest_and_problems(spark, monkeypatch):
    from shelfmark.sources import listings

    walks, walk = [], listings.reachable_pages
    for module in (listings, found):
        monkeypatch.setattr(module, "reachable_pages", lambda *args: walks.append(1) or walk(*args), raising=False)
    pages = spark.createDataFrame([("a", URL % 1, page([file_entry("x"), 5]))], "source_id string, page_url string, body string")
    manifest, problems, verdicts = found.read_osf(pages, pages.select("source_id", "page_url"))
    assert (manifest.count(), problems.count(), verdicts.count()) == (1, 1, 1)
    assert len(walks) == 1
