"""Provider payloads built from the driver's tables, so that parsing them is real work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES_PER_SOURCE = 50
PAGES_PER_FOLDER = 5
ENTRIES_PER_PAGE = 20
PAGE_SIZE = "page%5Bsize%5D=100"


def _page_url(source, page):
    return F.concat(F.lit("https://api.osf.io/v2/nodes/"), source, F.lit("/files/osfstorage/p"), page.cast("string"), F.lit("/"))


def osf_pages(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listing pages of OSF-like sources and the root page of each.

    Twenty orders make a page, fifty pages a source. Five pages chain to a folder, folders form a
    tree of head pages; one chain and one folder link lead back, and every third source lacks the
    link to folder 4, so that its subtree is unreachable.
    """
    index = F.expr(f"o_orderkey div {ENTRIES_PER_PAGE}")
    source_no = F.expr(f"o_orderkey div {ENTRIES_PER_PAGE * PAGES_PER_SOURCE}")
    placed = orders.select(
        F.concat(F.lit("osf"), source_no.cast("string")).alias("source_id"), source_no.alias("source_no"),
        (index % PAGES_PER_SOURCE).alias("page"), "o_orderkey", F.floor("o_totalprice").cast("bigint").alias("size"),
    )
    folder = F.expr(f"page div {PAGES_PER_FOLDER}")
    file_entry = F.struct(
        F.struct(
            F.lit("file").alias("kind"),
            F.concat(F.lit("/folder"), folder.cast("string"), F.lit("/file-"), F.col("o_orderkey").cast("string"), F.lit(".bin")).alias("materialized_path"),
            F.col("size").alias("size"),
        ).alias("attributes"),
        F.struct(F.concat(F.lit("https://files.osf.io/"), F.col("o_orderkey").cast("string")).alias("download")).alias("links"),
        F.lit(None).cast("struct<files: struct<links: struct<related: struct<href: string>>>>").alias("relationships"),
    )
    files = placed.withColumn("e", file_entry).groupBy("source_id", "source_no", "page").agg(
        F.collect_list("e").alias("files")  # twenty by construction
    )

    def folder_entry(child):
        url = _page_url(F.col("source_id"), child * PAGES_PER_FOLDER)
        return F.struct(
            F.struct(F.lit("folder").alias("kind"), F.concat(F.lit("/folder"), child.cast("string")).alias("materialized_path"),
                     F.lit(None).cast("bigint").alias("size")).alias("attributes"),
            F.struct(F.lit(None).cast("string").alias("download")).alias("links"),
            F.struct(F.struct(F.struct(F.struct(url.alias("href")).alias("related")).alias("links")).alias("files")).alias("relationships"),
        )

    number = F.expr(f"page div {PAGES_PER_FOLDER}")
    head = F.col("page") % PAGES_PER_FOLDER == 0
    folders = F.filter(
        F.array(number * 2 + 1, number * 2 + 2, F.when(number == 9, F.lit(0).cast("bigint"))),
        lambda c: (c < PAGES_PER_SOURCE // PAGES_PER_FOLDER) & ~((c == 4) & (F.col("source_no") % 3 == 1)),
    )
    entries = F.when(head, F.concat("files", F.transform(folders, folder_entry))).otherwise(F.col("files"))
    following = (
        F.when(F.col("page") == 19, F.lit(15)).when(F.col("page") % PAGES_PER_FOLDER != PAGES_PER_FOLDER - 1, F.col("page") + 1)
    )
    next_url = F.concat(_page_url(F.col("source_id"), following), F.lit("?" + PAGE_SIZE))
    body = F.to_json(F.struct(entries.alias("data"), F.struct(next_url.alias("next")).alias("links")))
    pages = files.select(
        "source_id", F.concat(_page_url(F.col("source_id"), F.col("page")), F.lit("?" + PAGE_SIZE)).alias("page_url"), body.alias("body")
    )
    roots = placed.select("source_id").distinct().select(
        "source_id", F.concat(_page_url(F.col("source_id"), F.lit(0)), F.lit("?" + PAGE_SIZE)).alias("page_url")
    )
    return pages, roots


def zenodo_records(orders: DataFrame) -> DataFrame:
    """Record payloads of ten files, every other one in the older layout."""
    record = F.expr("o_orderkey div 10")
    key = F.col("o_orderkey").cast("string")
    item = orders.select(
        record.alias("record"), key.alias("k"), F.floor("o_totalprice").cast("bigint").alias("size"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("md5:"), F.md5(key))).alias("checksum"),
    )
    name = F.concat(F.lit("data/"), "k", F.lit(".bin"))
    url = F.concat(F.lit("https://zenodo.org/files/"), "k")
    current = F.struct(name.alias("key"), "size", "checksum", F.struct(url.alias("content")).alias("links"))
    older = F.struct(name.alias("filename"), "size", "checksum", F.struct(url.alias("self")).alias("links"))
    grouped = item.groupBy("record").agg(
        F.collect_list(current).alias("current"), F.collect_list(F.struct(F.col("k"), older)).alias("older")  # ten by construction
    )
    body = F.when(F.col("record") % 2 == 0, F.to_json(F.struct(F.col("current").alias("files")))).otherwise(
        F.to_json(F.struct(F.struct(F.map_from_entries("older").alias("entries")).alias("files")))
    )
    return grouped.select(F.concat(F.lit("zen"), F.col("record").cast("string")).alias("source_id"), body.alias("body"))


def hub_listings(orders: DataFrame) -> DataFrame:
    """Dry-run listings of twenty-five records."""
    record = F.struct(
        F.concat(F.lit("shard-"), F.col("o_orderkey").cast("string"), F.lit(".fif")).alias("filename"),
        F.when(F.col("o_orderkey") % 71 == 1, F.lit(-1)).otherwise(F.floor("o_totalprice")).cast("bigint").alias("file_size"),
        (F.col("o_orderkey") % 3 != 0).alias("will_download"),
    )
    grouped = orders.groupBy(F.expr("o_orderkey div 25").alias("listing")).agg(F.array_sort(F.collect_list(record)).alias("records"))
    return grouped.select(F.concat(F.lit("hub"), F.col("listing").cast("string")).alias("source_id"), F.to_json("records").alias("body"))


def broken_osf_pages(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages of ``osf_pages`` with one fault in seven of eight sources, by the number of the source."""
    pages, roots = osf_pages(orders)
    fault = F.substring("source_id", 4, 20).cast("bigint") % 8
    number = F.regexp_extract("page_url", r"/p(\d+)/", 1).cast("int")
    at = lambda case, page: (F.col("fault") == case) & (F.col("number") == page)
    body = F.col("body")
    # After the files of page 1, which holds no folders: an entry of a kind nobody knows, and one that is no object.
    odd = F.regexp_replace(body, r"\],\"links\":\{", ',{"attributes":{"kind":"link"}},7],"links":{')
    faulty = (
        F.when(at(1, 3), F.lit("<html>")).when(at(2, 7), F.lit('{"data":5}')).when(at(5, 1), odd)
        .when(at(6, 2), F.regexp_replace(body, r'"links":\{"next":"[^"]*"\}\}\z', '"links":{"next":7}}'))
        .when(at(7, 0), F.lit('{"data":[],"links":{"next":null}}')).otherwise(body)
    )
    marked = pages.withColumn("fault", fault).withColumn("number", number)
    return marked.filter(~at(3, 12) & ~at(4, 0)).select("source_id", "page_url", faulty.alias("body")), roots


def broken_zenodo_records(orders: DataFrame) -> DataFrame:
    """The records of ``zenodo_records`` with a fault in five of nine, by the number of the record."""
    fault = F.substring("source_id", 4, 20).cast("bigint") % 9
    bodies = {1: "oops", 2: '{"files":3}', 3: '{"files":{"entries":4}}', 4: '{"files":[]}', 5: '{"files":[7]}'}
    body = F.col("body")
    for case, text in bodies.items():
        body = F.when(fault == case, F.lit(text)).otherwise(body)
    return zenodo_records(orders).select("source_id", body.alias("body"))


def broken_hub_listings(orders: DataFrame) -> DataFrame:
    """The listings of ``hub_listings``, one of seven without a list."""
    fault = F.substring("source_id", 4, 20).cast("bigint") % 7 == 1
    return hub_listings(orders).select("source_id", F.when(fault, F.lit("{}")).otherwise(F.col("body")).alias("body"))


def zenodo_local_files(orders: DataFrame) -> DataFrame:
    """Files already fetched from the records: all of every other record, and of the others those with even keys."""
    key = F.col("o_orderkey").cast("string")
    record = F.expr("o_orderkey div 10")
    return orders.filter((record % 2 == 0) | (F.col("o_orderkey") % 2 == 0)).select(
        F.concat(F.lit("zen"), record.cast("string")).alias("source_id"), F.concat(F.lit("data/"), key, F.lit(".bin")).alias("relative_path"),
        F.lit("file").alias("kind"), F.floor("o_totalprice").cast("bigint").alias("size"), F.concat(F.lit("md5:"), F.md5(key)).alias("checksum"),
    )
