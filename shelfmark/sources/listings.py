"""Provider listings: JSON pages and records to manifest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.session import counted_cut, cut_lineage


def json_value(body):
    """A JSON text as a value to look into, null where it is none."""
    return F.try_parse_json(body)


def json_list(value):
    """The elements of a JSON array, null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def json_object(value):
    """The members of a JSON object, null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def json_member(value, *names: str):
    """What a path of names leads to inside JSON objects, null where it leads nowhere."""
    return F.try_variant_get(value, "$." + ".".join(names), "variant")


def json_text(value):
    """A JSON text, null for anything else."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def json_integer(value):
    """A JSON integer, null for anything else (also for booleans and texts)."""
    return F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def by_name(members):
    """The values of a map of JSON members, by ascending name."""
    ordered = F.array_sort(
        F.map_entries(members), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    )
    return F.transform(ordered, lambda entry: entry["value"])


def page_address(url):
    """Listing URL with the largest page size, the form pages are stored under."""
    size = f"page%5Bsize%5D={vocab.LISTING_PAGE_SIZE}"
    return F.when(url.contains("page%5Bsize%5D="), url).when(url.contains("?"), F.concat(url, F.lit("&" + size))).otherwise(
        F.concat(url, F.lit("?" + size))
    )


def _whole_number(value):
    """Non-negative JSON integer, null for anything else."""
    return F.when(json_integer(value) >= 0, json_integer(value))


def folder_address(entry):
    """The related link of a folder entry: a plain text or an object with an href."""
    related = json_member(entry, "relationships", "files", "links", "related")
    return F.coalesce(json_text(related), json_text(json_member(related, "href")))


def next_page(page):
    """Address of the page after a page, null where there is none."""
    return F.nullif(json_text(json_member(page, "links", "next")), F.lit(""))


def osf_entries(pages: DataFrame) -> DataFrame:
    """Entries of stored pages (source_id, page_url, body): number on the page, kind, path, size and links.

    Each entry is read on its own, so an odd one takes nothing of its neighbours with it.
    """
    listed = json_list(json_member(json_value(F.col("body")), "data"))
    e = F.col("e")
    return pages.select("source_id", "page_url", F.posexplode(listed).alias("entry", "e")).select(
        "source_id", "page_url", "entry", json_text(json_member(e, "attributes", "kind")).alias("kind"),
        json_text(json_member(e, "attributes", "materialized_path")).alias("relative_path"),
        _whole_number(json_member(e, "attributes", "size")).alias("size"),
        json_text(json_member(e, "links", "download")).alias("download_url"), folder_address(e).alias("folder_url"),
    )


def reachable_pages(pages: DataFrame, roots: DataFrame, entries: DataFrame) -> DataFrame:
    """(source_id, page_url) of the pages a walk from the roots visits, each once.

    Next-page links form chains as long as a folder is big. Pages where a walk can enter or meet
    (roots, folder targets, pages with several predecessors) are heads; every other page finds
    the head of its chain by pointer doubling, so a chain of n pages costs log n rounds. The walk
    itself then runs over heads only, one round per folder level. Cycles end as nothing is new.
    """
    keys = ["source_id", "page_url"]
    stored = cut_lineage(
        pages.select(*keys, next_page(json_value(F.col("body"))).alias("next_url")).dropDuplicates(keys)
    )
    known = stored.select(*keys)
    follows = stored.filter("next_url is not null").select("source_id", "page_url", F.col("next_url").alias("target"))
    folders = cut_lineage(entries.filter("kind = 'folder' and folder_url is not null").select(
        *keys, page_address(F.col("folder_url")).alias("target")
    ))
    meeting = follows.groupBy("source_id", "target").agg(F.count("*").alias("n")).filter("n > 1")
    heads = cut_lineage(
        roots.select(*keys)
        .unionByName(folders.select("source_id", F.col("target").alias("page_url")))
        .unionByName(meeting.select("source_id", F.col("target").alias("page_url")))
        .distinct().join(known, keys, "left_semi")
    )
    target_is_head = heads.withColumnRenamed("page_url", "target")
    # Chain links point backwards: every page that is no head has one page before it.
    pointers, open_pages = counted_cut(
        follows.join(target_is_head, ["source_id", "target"], "left_anti")
        .select("source_id", F.col("target").alias("page_url"), F.col("page_url").alias("before")).join(known, keys, "left_semi")
    )
    placed = heads.select(*keys, F.col("page_url").alias("head"))
    while open_pages:
        located = placed.select("source_id", F.col("page_url").alias("before"), "head")
        fresh, found = counted_cut(pointers.join(located, ["source_id", "before"]).select(*keys, "head"))
        if not found:
            break  # what is left hangs on no head: nothing reaches it
        placed = placed.unionByName(fresh)
        hop = pointers.select("source_id", F.col("page_url").alias("before"), F.col("before").alias("further"))
        pointers, open_pages = counted_cut(
            pointers.join(fresh, keys, "left_anti").join(hop, ["source_id", "before"]).select(*keys, F.col("further").alias("before"))
        )
    placed = cut_lineage(placed)
    links = follows.join(target_is_head, ["source_id", "target"], "left_semi").unionByName(folders)
    steps = cut_lineage(
        links.join(placed, keys).select("source_id", "head", F.col("target").alias("child")).distinct()
        .join(heads.withColumnRenamed("page_url", "child"), ["source_id", "child"], "left_semi")
    )
    frontier, new = counted_cut(roots.select("source_id", F.col("page_url").alias("head")).distinct().join(
        heads.withColumnRenamed("page_url", "head"), ["source_id", "head"], "left_semi"))
    reached = frontier
    while new:
        children = frontier.join(steps, ["source_id", "head"]).select("source_id", F.col("child").alias("head")).distinct()
        frontier, new = counted_cut(children.join(reached, ["source_id", "head"], "left_anti"))
        reached = reached.unionByName(frontier)
    return placed.join(reached, ["source_id", "head"], "left_semi").select(*keys)


def osf_walk(pages: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries of all pages and the (source_id, page_url) that a walk visits, both read and stored once."""
    entries = cut_lineage(osf_entries(pages))
    return entries, cut_lineage(reachable_pages(pages, roots, entries))


def osf_manifest(pages: DataFrame, roots: DataFrame, walk: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Files on the listing pages reachable from each source's root page; ``walk`` is ``osf_walk`` of them."""
    entries, visited = walk or osf_walk(pages, roots)
    return entries.filter("kind = 'file'").join(visited, ["source_id", "page_url"], "left_semi").select(
        "source_id", F.ltrim("relative_path", F.lit("/")).alias("relative_path"), "size", "download_url",
        F.lit(None).cast("string").alias("checksum"),
    )


def zenodo_items(body):
    """The files of a record in the list layout or the older entries layout (by name), null where it has neither."""
    record = json_value(body)
    return F.coalesce(json_list(json_member(record, "files")), by_name(json_object(json_member(record, "files", "entries"))))


def zenodo_manifest(records: DataFrame) -> DataFrame:
    """Files of record payloads (source_id, body) in the list layout or the older entries layout."""
    f = F.col("f")
    either = lambda *paths: F.coalesce(*[F.nullif(json_text(json_member(f, *p)), F.lit("")) for p in paths])
    return records.select("source_id", F.explode(zenodo_items(F.col("body"))).alias("f")).select(
        "source_id", either(["key"], ["filename"]).alias("relative_path"), _whole_number(json_member(f, "size")).alias("size"),
        either(["links", "content"], ["links", "self"]).alias("download_url"), either(["checksum"]).alias("checksum"),
    )


def hub_listing(listings: DataFrame) -> DataFrame:
    """Pending files of dry-run listings (source_id, body); a bad size is named."""
    r = F.col("r")
    size = json_integer(json_member(r, "file_size"))
    return listings.select("source_id", F.explode(json_list(json_value(F.col("body")))).alias("r")).filter(
        F.try_variant_get(r, "$.will_download", "boolean")
    ).select(
        "source_id", json_text(json_member(r, "filename")).alias("relative_path"), size.alias("size"),
        F.when(size.isNull() | (size < 0), "bad size").alias("problem"),
    )
