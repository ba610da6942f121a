"""What is wrong with provider listings, as rows beside the files they yield, and one verdict per listing.

A listing with any fatal problem, or with a manifest row that breaks a rule, must not be used in
part: a transfer planned from the rest would look complete. Rows of the bad places are therefore
kept as problems and the verdict travels with the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.manifests import compared_files, judged_manifest
from shelfmark.sources.listings import (
    folder_address,
    hub_listing,
    json_integer,
    json_list,
    json_member,
    json_object,
    json_text,
    json_value,
    next_page,
    osf_manifest,
    osf_walk,
    page_address,
    zenodo_items,
    zenodo_manifest,
)

PAGE_KEYS = ["source_id", "page_url"]
#: Problems that leave the rest of a listing usable.
NOTES = ["stored page is not reachable"]


def _absent(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def _first_of(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that fails, null where none does."""
    found = F.lit(None).cast("string")
    for failed, name in reversed(checks):
        found = F.when(failed, F.lit(name)).otherwise(found)
    return found


def _rows(place: DataFrame, problem: Column, entry: Column | None = None) -> DataFrame:
    """(source_id, place, entry, problem) of the rows that have one."""
    number = F.lit(None).cast("int") if entry is None else entry
    return place.select("source_id", "place", number.alias("entry"), problem.alias("problem")).filter("problem is not null")


def _page_problems(visited: DataFrame) -> DataFrame:
    """Pages that are no collection, and their entries; ``visited`` has source_id, place, body."""
    v, e = F.col("v"), F.col("e")
    pages = visited.withColumn("v", json_value(F.col("body")))
    data, links, following = json_member(v, "data"), json_member(v, "links"), json_member(v, "links", "next")
    page = _rows(pages, _first_of(
        (json_object(v).isNull(), "page is no object"),
        (json_list(data).isNull(), "data is no list"),
        (~_absent(links) & json_object(links).isNull(), "links are no object"),
        (~_absent(following) & next_page(v).isNull(), "next page is no address"),
    ))
    entries = pages.select("source_id", "place", F.posexplode(json_list(data)).alias("entry", "e"))
    kind = F.coalesce(json_text(json_member(e, "attributes", "kind")), F.lit(""))
    entry = _rows(entries, _first_of(
        (json_object(e).isNull(), "entry is no object"),
        (json_object(json_member(e, "attributes")).isNull(), "entry has no attributes"),
        (~kind.isin("file", "folder"), "entry is neither file nor folder"),
        ((kind == "file") & json_object(json_member(e, "links")).isNull(), "file has no links"),
        ((kind == "folder") & folder_address(e).isNull(), "folder has no address"),
    ), F.col("entry"))
    return page.unionByName(entry)


def osf_problems(pages: DataFrame, roots: DataFrame, walk: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Problems of stored listing pages: ``source_id``, ``place`` (page address), ``entry`` (number from 0 or null), ``problem``.

    Only pages that a walk from the roots visits are judged, as only they give files. Links of
    visited pages that lead to no stored page are one problem of the page that holds them, and a
    source whose visited pages hold no file is an empty listing. Stored pages that nothing reaches
    are notes. Null bodies count as unreadable; a page stored twice is judged twice. ``walk`` is
    ``osf_walk`` of the pages, where it has been made already.
    """
    entries, visited = walk or osf_walk(pages, roots)
    known = pages.select(*PAGE_KEYS).distinct()
    read = pages.join(visited, PAGE_KEYS, "left_semi")
    broken = _page_problems(read.withColumnRenamed("page_url", "place"))
    following = read.select(*PAGE_KEYS, next_page(json_value(F.col("body"))).alias("target")).filter("target is not null")
    folders = entries.filter("kind = 'folder' and folder_url is not null").join(visited, PAGE_KEYS, "left_semi").select(
        *PAGE_KEYS, page_address(F.col("folder_url")).alias("target")
    )
    stored = known.withColumnRenamed("page_url", "target")

    def dangling(rows: DataFrame, problem: str) -> DataFrame:
        lost = rows.distinct().join(stored, ["source_id", "target"], "left_anti").select(*PAGE_KEYS).distinct()
        return _rows(lost.withColumnRenamed("page_url", "place"), F.lit(problem))

    rootless = roots.select(*PAGE_KEYS).distinct().join(known, PAGE_KEYS, "left_anti").withColumnRenamed("page_url", "place")
    unreached = known.join(visited, PAGE_KEYS, "left_anti").withColumnRenamed("page_url", "place")
    filled = entries.filter("kind = 'file'").join(visited, PAGE_KEYS, "left_semi").select("source_id")
    empty = roots.select("source_id").distinct().join(filled, "source_id", "left_anti").withColumn("place", F.lit(None).cast("string"))
    return (
        broken.unionByName(dangling(following, "next page is not stored")).unionByName(dangling(folders, "folder page is not stored"))
        .unionByName(_rows(rootless, F.lit("first page is not stored"))).unionByName(_rows(unreached, F.lit(NOTES[0])))
        .unionByName(_rows(empty, F.lit("listing has no files")))
    )


def zenodo_problems(records: DataFrame) -> DataFrame:
    """Problems of record payloads (source_id, body), in either layout; ``place`` is null.

    Null bodies count as unreadable. Items of the older layout are numbered by ascending key.
    """
    v, e = F.col("v"), F.col("e")
    parsed = records.select(
        "source_id", F.lit(None).cast("string").alias("place"), json_value(F.col("body")).alias("v"), zenodo_items(F.col("body")).alias("items")
    )
    files = json_member(v, "files")
    record = _rows(parsed, _first_of(
        (json_object(v).isNull(), "record is no object"),
        (json_list(files).isNull() & json_object(files).isNull(), "files are neither list nor object"),
        (F.col("items").isNull(), "entries are no object"),
        (F.size("items") == 0, "listing has no files"),
    ))
    item = _rows(parsed.select("source_id", "place", F.posexplode("items").alias("entry", "e")), _first_of(
        (json_object(e).isNull(), "file is no object"), (json_object(json_member(e, "links")).isNull(), "file has no links"),
    ), F.col("entry"))
    return record.unionByName(item)


def hub_problems(listings: DataFrame) -> DataFrame:
    """Problems of dry-run listings (source_id, body); a listing without pending files is sound.

    The size matters only where a file is to be fetched. Null bodies count as unreadable.
    """
    v, e = F.col("v"), F.col("e")
    parsed = listings.select("source_id", F.lit(None).cast("string").alias("place"), json_value(F.col("body")).alias("v"))
    whole = _rows(parsed, _first_of((json_list(v).isNull(), "listing is no list")))
    size = json_integer(json_member(e, "file_size"))
    pending = F.coalesce(F.try_variant_get(e, "$.will_download", "boolean"), F.lit(False))
    item = _rows(parsed.select("source_id", "place", F.posexplode(json_list(v)).alias("entry", "e")), _first_of(
        (json_object(e).isNull(), "record is no object"), (pending & ~F.coalesce(size >= 0, F.lit(False)), "bad size"),
    ), F.col("entry"))
    return whole.unionByName(item)


def _by_place() -> Column:
    """Problems in the order of pages and entries, those of a page before its entries', those of a whole listing last."""
    return F.struct(F.col("place").isNull().alias("whole"), "place", F.coalesce("entry", F.lit(-1)).alias("entry"), "problem")


def listing_verdicts(sources: DataFrame, manifest: DataFrame, problems: DataFrame) -> DataFrame:
    """One row per source: files, rejected rows, problems, accepted bytes, the first problem and ``usable``.

    ``sources`` names every source that was listed, so that one without a single file has a verdict
    too. ``manifest`` holds the rows its listing gave, which the manifest rules judge. Both sides are
    counted before they meet, so a source costs the join one row whatever its size.
    """
    rows = judged_manifest(manifest).groupBy("source_id").agg(
        F.count("*").alias("files"), F.count_if(F.size("errors") > 0).alias("rejected"),
        F.sum(F.when(F.size("errors") == 0, F.col("size"))).alias("bytes"),
    )
    fatal = ~F.col("problem").isin(NOTES)
    found = problems.groupBy("source_id").agg(
        F.count_if(fatal).alias("problems"), F.count_if(~fatal).alias("notes"),
        F.min(F.when(fatal, _by_place())).alias("first"),
    )
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    joined = sources.select("source_id").distinct().join(rows, "source_id", "left").join(found, "source_id", "left")
    return joined.select(
        "source_id", zero("files"), zero("rejected"), zero("problems"), zero("notes"), zero("bytes"), F.col("first.problem").alias("first_problem"),
        ((F.coalesce("rejected", F.lit(0)) == 0) & (F.coalesce("problems", F.lit(0)) == 0)).alias("usable"),
    )


def usable_manifest(manifest: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows, in normal form, of the sources whose whole listing is usable: what transfers are planned from."""
    sound = verdicts.filter("usable").select("source_id")
    return judged_manifest(manifest.join(sound, "source_id", "left_semi")).drop("errors")


def listing_outcomes(manifest: DataFrame, verdicts: DataFrame, files: DataFrame) -> DataFrame:
    """What becomes of every listed source: ``reject`` its listing, ``transfer`` what is pending, or ``complete``.

    Pending files and bytes, and the first pending path, are those of usable listings only.
    """
    compared = compared_files(usable_manifest(manifest, verdicts), files)
    pending = compared.filter("pending").groupBy("source_id").agg(
        F.count("*").alias("pending"), F.sum("size").alias("pending_bytes"), F.min("relative_path").alias("first_pending")
    )
    joined = verdicts.join(pending, "source_id", "left")
    action = F.when(~F.col("usable"), "reject").when(F.col("pending").isNotNull(), "transfer").otherwise("complete")
    return joined.select(
        "source_id", action.alias("action"), "files", "first_problem",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pending", "pending_bytes")], "first_pending",
    )


def read_osf(pages: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest, problems, verdicts) of stored pages."""
    walk = osf_walk(pages, roots)  # the pages are walked once for both
    manifest, problems = osf_manifest(pages, roots, walk), osf_problems(pages, roots, walk)
    return manifest, problems, listing_verdicts(roots, manifest, problems)


def read_zenodo(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest, problems, verdicts) of record payloads."""
    manifest, problems = zenodo_manifest(records), zenodo_problems(records)
    return manifest, problems, listing_verdicts(records, manifest, problems)


def read_hub(listings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pending files, problems, verdicts) of dry-run listings; their rows have no address to judge."""
    pending, problems = hub_listing(listings), hub_problems(listings)
    counted = pending.groupBy("source_id").agg(
        F.count("*").alias("files"), F.sum(F.when(F.col("problem").isNull(), F.col("size"))).alias("bytes")
    )
    found = problems.groupBy("source_id").agg(
        F.count("*").alias("problems"),
        F.min(_by_place()).alias("first"),
    )
    joined = listings.select("source_id").distinct().join(counted, "source_id", "left").join(found, "source_id", "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    verdicts = joined.select(
        "source_id", zero("files"), F.lit(0).cast("bigint").alias("rejected"), zero("problems"), F.lit(0).cast("bigint").alias("notes"),
        zero("bytes"), F.col("first.problem").alias("first_problem"), F.col("problems").isNull().alias("usable"),
    )
    return pending, problems, verdicts
