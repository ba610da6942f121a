"""File manifests: validation, comparison with local files and transfer planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.functions import paths
from shelfmark.functions.tables import reason_list

PATH_KEYS = ["source_id", "relative_path"]


def _normal_parts(path: Column) -> Column:
    """Path parts as a POSIX path sees them: empty and ``.`` parts vanish."""
    return F.array_remove(F.array_remove(F.split(F.ltrim(path, F.lit("/")), "/"), ""), ".")


def _checksum_is_valid(checksum: Column) -> Column:
    valid = F.lit(False)
    for algorithm, length in vocab.CHECKSUM_HEX_LENGTHS.items():
        valid = valid | checksum.rlike(rf"^{algorithm}:[0-9a-fA-F]{{{length}}}\z")
    return valid


def judged_manifest(manifest: DataFrame) -> DataFrame:
    """Manifest rows in normal form with the list of rules each breaks."""
    staged = manifest.withColumn("_parts", _normal_parts(F.col("relative_path")))
    counted = staged.withColumn("_normal", F.array_join("_parts", "/")).withColumn("_checksum", F.nullif("checksum", F.lit("")))
    repeats = counted.filter("_normal <> ''").groupBy("source_id", F.col("_normal").alias("_path")).agg(F.count("*").alias("_copies")).filter("_copies > 1")
    joined = counted.join(
        repeats.withColumnRenamed("source_id", "_source"),
        (F.col("source_id") == F.col("_source")) & (F.col("_normal") == F.col("_path")), "left",
    )
    errors = reason_list(
        (F.coalesce(F.col("_normal"), F.lit("")) == "", "empty path"),
        (F.array_contains("_parts", ".."), "unsafe path"),
        (F.col("size").isNull() | (F.col("size") < 0), "bad size"),
        (~F.coalesce(F.col("download_url").rlike(r"^(?i:https?)://(?:[^/?#]*@)?[^/?#:@]"), F.lit(False)), "bad url"),
        (F.col("_checksum").isNotNull() & ~_checksum_is_valid(F.col("_checksum")), "bad checksum"),
        (F.col("_copies") > 1, "duplicate path"),
    )
    return joined.select(
        "source_id", F.when(F.col("_normal") != "", F.col("_normal")).alias("relative_path"), "size", "download_url",
        F.lower("_checksum").alias("checksum"), errors.alias("errors"),
    )


def accepted_manifest(manifest: DataFrame) -> DataFrame:
    return judged_manifest(manifest).filter(F.size("errors") == 0).drop("errors")


def rejected_manifest(manifest: DataFrame) -> DataFrame:
    return judged_manifest(manifest).filter(F.size("errors") > 0)


def source_verdicts(manifest: DataFrame) -> DataFrame:
    """Per source: rows, rejected rows and whether the listing as a whole is usable."""
    return judged_manifest(manifest).groupBy("source_id").agg(
        F.count("*").alias("files"), F.count_if(F.size("errors") > 0).alias("rejected"),
        F.sum(F.when(F.size("errors") == 0, F.col("size"))).alias("accepted_bytes"),
    ).withColumn("usable", F.col("rejected") == 0)


def duplicate_paths(manifest: DataFrame) -> DataFrame:
    """Paths a source advertises more than once."""
    normal = manifest.select("source_id", F.array_join(_normal_parts(F.col("relative_path")), "/").alias("relative_path"))
    return normal.filter("relative_path <> ''").groupBy(*PATH_KEYS).agg(F.count("*").alias("copies")).filter("copies > 1")


def _local(files: DataFrame, prefix: str) -> DataFrame:
    return files.select(
        "source_id", "relative_path",
        *[F.col(c).alias(f"{prefix}_{c}") for c in ("kind", "size", "checksum")],
    )


def _complete(prefix: str) -> Column:
    return (
        (F.col(f"{prefix}_kind") == "file") & (F.col(f"{prefix}_size") == F.col("size"))
        & (F.col("checksum").isNull() | F.col(f"{prefix}_checksum").eqNullSafe(F.col("checksum")))
    )


def compared_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows with ``pending``: absent, not a regular file, or differing in size or checksum."""
    joined = manifest.join(_local(files, "local"), PATH_KEYS, "left")
    return joined.withColumn("pending", ~F.coalesce(_complete("local"), F.lit(False)))


def pending_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    return compared_files(manifest, files).filter("pending").select(
        "source_id", "relative_path", "size", F.coalesce("local_kind", F.lit("absent")).alias("found"), F.col("local_size").alias("found_size"),
    )


def transfer_plan(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """What a transfer does with every manifest row, given the final and the partial file."""
    partials = _local(
        files.filter(F.col("relative_path").endswith(".part")).withColumn(
            "relative_path", F.regexp_replace("relative_path", r"\.part\z", "")
        ), "part",
    )
    joined = manifest.join(_local(files, "local"), PATH_KEYS, "left").join(partials, PATH_KEYS, "left")
    full = F.col("part_size") == F.col("size")
    action = (
        F.when(F.col("local_kind").isNotNull() & _complete("local"), "skip")
        .when(F.col("local_kind").isNotNull(), "conflict")
        .when(F.col("part_kind") != "file", "reject_partial")
        .when(F.col("part_size") > F.col("size"), "partial_too_large")
        .when(full & (F.col("checksum").isNull() | F.col("part_checksum").eqNullSafe(F.col("checksum"))), "publish")
        .when(full, "partial_corrupt")
        .when(F.col("part_size") > 0, "resume")
        .otherwise("download")
    )
    planned = joined.withColumn("action", action)
    offset = F.when(F.col("action") == "resume", F.col("part_size")).when(F.col("action") == "download", F.lit(0))
    return planned.select("source_id", "relative_path", "size", "action", offset.cast("bigint").alias("offset"))


def transfer_summary(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files and bytes still to transfer per source."""
    return compared_files(manifest, files).groupBy("source_id").agg(
        F.count("*").alias("files"), F.count_if("pending").alias("pending"),
        F.coalesce(F.sum(F.when(F.col("pending"), F.col("size"))), F.lit(0)).alias("pending_bytes"),
        F.round(F.coalesce(F.sum(F.when(F.col("pending"), F.col("size"))), F.lit(0)) / F.lit(1024.0**3), 2).alias("pending_gib"),
        F.round(F.max(F.when(F.col("pending"), F.col("size"))) / F.lit(1024.0**2), 2).alias("largest_mib"),
    )


def verify_complete(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Sources that still have pending files, with the first of them."""
    return compared_files(manifest, files).filter("pending").groupBy("source_id").agg(
        F.count("*").alias("pending"), F.min("relative_path").alias("first_pending")
    ).withColumn(
        "message",
        F.concat(F.lit("download verification found "), "pending", F.lit(" pending files; first pending file: "), "first_pending", F.lit(".")),
    )


def workspace_plan(requests: DataFrame, workspaces: DataFrame) -> DataFrame:
    """How a download starts, given what its incoming workspace holds.

    ``workspaces`` has one row per entry, and one with a null path for an empty workspace.
    """
    held = workspaces.groupBy("workspace").agg(
        F.count("relative_path").alias("entries"),
        F.coalesce(F.bool_or((F.col("relative_path") == ".git") | F.col("relative_path").startswith(".git/")), F.lit(False)).alias("checkout"),
        F.max("exact_tag").alias("exact_tag"),
    )
    asked = requests.withColumn("workspace", paths.workspace(F.col("provider"), F.col("url"), F.col("version")))
    action = (
        F.when(F.col("entries").isNull(), "new")
        .when(F.col("checkout") & ~F.col("exact_tag").eqNullSafe(F.col("version")), "reject")
        .when(F.col("checkout"), "resume")
        .when(F.col("entries") == 0, "retry")
        .otherwise("reject")
    )
    reason = F.when(F.col("checkout") & (action == "reject"), "version differs").when(action == "reject", "not a checkout")
    return asked.join(held, "workspace", "left").select("request_id", "workspace", action.alias("action"), reason.alias("reason"))
