"""File inventory: sizes, payload markers, missing content and access planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.functions import paths
from shelfmark.functions.tables import top_per_key
from shelfmark.session import cut_lineage

EXAMPLES = 5


def _is_regular() -> Column:
    target = F.coalesce(F.col("target_kind") == "file", F.lit(False))
    return ~F.col("is_dangling") & ((F.col("kind") == "file") | ((F.col("kind") == "symlink") & target))


def _below(name: str) -> Column:
    return (F.col("relative_path") == name) | F.col("relative_path").startswith(name + "/")


def _marker_flags() -> dict[str, Column]:
    """Facts of one entry that, or-ed over a dataset, tell what the dataset is."""
    payload = F.col("kind").isin("file", "special") | (
        (F.col("kind") == "symlink") & ~F.coalesce(F.col("target_kind") == "dir", F.lit(False))
    )
    return {
        "has_payload": payload & ~F.col("relative_path").rlike(r"(^|/)\."),
        "has_git": _below(".git"), "has_datalad": _below(".datalad"), "has_annex": _below(".git/annex"),
    }


def _markers(flagged: DataFrame, *others: str) -> DataFrame:
    return flagged.select(
        "dataset_id", "entries", "has_payload",
        (F.col("has_git") & (F.col("has_datalad") | F.col("has_annex"))).alias("is_checkout"), *others,
    )


def dataset_sizes(inventory: DataFrame) -> DataFrame:
    """Bytes per dataset: regular files behind every entry, each inode once; 0 where there are none.

    The inodes are made distinct first, on (dataset, device, inode), so a dataset that holds a
    third of all files is spread over all tasks; the sum per dataset then runs on partial sums.
    """
    inodes = inventory.groupBy("dataset_id", "dev", "ino").agg(F.max(F.when(_is_regular(), F.col("size"))).alias("size"))
    return inodes.groupBy("dataset_id").agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.count("size").alias("inodes")
    )


def payload_markers(inventory: DataFrame) -> DataFrame:
    """Per dataset: whether a visible payload exists and whether it is a versioned checkout."""
    found = inventory.groupBy("dataset_id").agg(
        *[F.bool_or(flag).alias(name) for name, flag in _marker_flags().items()], F.count("*").alias("entries")
    )
    return _markers(found)


def inventory_facts(inventory: DataFrame) -> DataFrame:
    """Markers and size per dataset from one pass over the inventory.

    Every marker is an or and every count a sum, so both ride along on the inode grouping the
    size needs anyway: one scan and one wide shuffle instead of two of each.
    """
    flags = _marker_flags()
    inodes = inventory.groupBy("dataset_id", "dev", "ino").agg(
        F.max(F.when(_is_regular(), F.col("size"))).alias("size"), F.count("*").alias("entries"),
        *[F.bool_or(flag).alias(name) for name, flag in flags.items()],
    )
    found = inodes.groupBy("dataset_id").agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.sum("entries").alias("entries"),
        *[F.bool_or(name).alias(name) for name in flags],
    )
    return _markers(found, "total_bytes")


def missing_content(inventory: DataFrame) -> DataFrame:
    """Annexed files of a dataset whose content is not stored locally."""
    annexed = (F.col("kind") == "symlink") & ~F.coalesce(F.col("target_kind") == "dir", F.lit(False))
    return inventory.filter(annexed & ~_below(".git") & ~F.col("content_present")).select("dataset_id", "relative_path").distinct()


def missing_content_summary(inventory: DataFrame) -> DataFrame:
    """Count and first five missing paths per dataset, and the message they make.

    Only five rows per dataset leave a map task for the examples, whatever the dataset holds.
    """
    missing = missing_content(inventory)
    counts = missing.groupBy("dataset_id").agg(F.count("*").alias("missing"))
    first = top_per_key(missing, ["dataset_id"], [F.col("relative_path")], EXAMPLES)
    examples = first.groupBy("dataset_id").agg(
        F.array_join(F.array_sort(F.collect_list("relative_path")), ", ").alias("examples")  # five at most
    )
    return counts.join(examples, "dataset_id").select(
        "dataset_id", "missing", "examples",
        F.concat(F.lit(vocab.CONTENT_MISSING), "examples").alias("message"),
    )


#: Facts of an entry that make it another one when they change.
ENTRY_FACTS = ("kind", "target_kind", "size", "is_dangling", "content_present", "checksum")


def inventory_digests(inventory: DataFrame) -> DataFrame:
    """(dataset_id, entries, digest): a sum of entry hashes, which tells inventories apart whatever their order."""
    mark = F.xxhash64("relative_path", *ENTRY_FACTS).cast("decimal(38,0)")
    return inventory.groupBy("dataset_id").agg(F.count("*").alias("entries"), F.sum(mark).alias("digest"))


def changed_datasets(before: DataFrame, after: DataFrame) -> DataFrame:
    """(dataset_id) of datasets whose inventories differ, those that one side lacks among them."""
    old, new = inventory_digests(before), inventory_digests(after).select("dataset_id", F.struct("entries", "digest").alias("new"))
    joined = old.select("dataset_id", F.struct("entries", "digest").alias("old")).join(new, "dataset_id", "full")
    return joined.filter(~F.col("old").eqNullSafe(F.col("new"))).select("dataset_id")


def inventory_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(dataset_id, relative_path, change) of entries that were ``added``, ``removed`` or ``changed``.

    Only rows of datasets whose digests differ are compared. Entries listed more than once count as
    one with all their facts, so an entry changes as soon as one of them does.
    """
    touched = cut_lineage(changed_datasets(before, after))

    def entries(inventory: DataFrame, name: str) -> DataFrame:
        mark = F.sum(F.xxhash64(*ENTRY_FACTS).cast("decimal(38,0)"))
        return inventory.join(touched, "dataset_id", "left_semi").groupBy("dataset_id", "relative_path").agg(mark.alias(name))

    joined = entries(before, "old").join(entries(after, "new"), ["dataset_id", "relative_path"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return joined.select("dataset_id", "relative_path", change.alias("change")).filter("change is not null")


def repair_evidence(before: DataFrame, after: DataFrame, repairs: DataFrame) -> DataFrame:
    """Repairs with what inventories before and after them tell: ``missing_after`` and ``remaining`` paths.

    ``repairs`` is (dataset_id, tool_present, exit_code, error, recheck_error). The later inventory
    is only searched for missing content where it differs; elsewhere what was missing still is.
    """
    touched = cut_lineage(changed_datasets(before, after))
    same = missing_content_summary(before.join(touched, "dataset_id", "left_anti"))
    other = missing_content_summary(after.join(touched, "dataset_id", "left_semi"))
    left = same.unionByName(other).select("dataset_id", F.col("missing").alias("missing_after"), F.col("examples").alias("remaining"))
    return repairs.select("dataset_id", "tool_present", "exit_code", "error", "recheck_error").join(left, "dataset_id", "left").withColumn(
        "missing_after", F.coalesce("missing_after", F.lit(0).cast("bigint"))
    )


def access_plan(inventory: DataFrame, caller_uid: int) -> DataFrame:
    """Mode every entry would get in managed storage and by publishing in place, and what blocks it."""
    public = paths.public_mode(F.col("kind"), F.col("mode"))
    planned = inventory.select(
        "dataset_id", "relative_path", "kind", "mode", "uid",
        paths.managed_mode(F.col("kind"), F.col("mode")).alias("managed_mode"), public.alias("public_mode"),
    )
    changes = F.coalesce(F.col("public_mode") != F.col("mode"), F.lit(False))
    blocked = changes & (F.lit(caller_uid) != 0) & (F.col("uid") != caller_uid)
    return planned.withColumn("changes", changes).withColumn("blocked", blocked)


def access_summary(inventory: DataFrame, caller_uid: int) -> DataFrame:
    """Per dataset: entries by planned managed mode and entries publishing would change."""
    return access_plan(inventory, caller_uid).groupBy("dataset_id").agg(
        F.count("*").alias("entries"),
        F.count_if(F.col("managed_mode") == 0o755).alias("executable"),
        F.count_if(F.col("managed_mode") == 0o644).alias("plain"),
        F.count_if(F.col("managed_mode").isNull()).alias("links"),
        F.count_if("changes").alias("changes"),
    )


def access_report(inventory: DataFrame, caller_uid: int) -> DataFrame:
    """Per dataset: entries to change, blocked entries, the first of them, and whether publishing may go on."""
    return access_plan(inventory, caller_uid).groupBy("dataset_id").agg(
        F.count_if("changes").alias("changes"), F.count_if("blocked").alias("blocked"),
        F.min(F.when(F.col("blocked"), F.col("relative_path"))).alias("first_blocked"),
    ).withColumn("publishable", F.col("blocked") == 0)
