"""Storage path and access-mode columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import vocab


def slug(value: Column) -> Column:
    """File-name form of a text: other characters become dashes, edges are trimmed."""
    dashed = F.regexp_replace(value, r"[^a-zA-Z0-9._-]+", "-")
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(dashed, r"^[.-]+|[.-]+$", "")), F.lit("")), F.lit("dataset"))


def destination(root: str, dataset_id: Column, name: Column, version: Column) -> Column:
    """Managed folder of a dataset below the root."""
    return F.concat(F.lit(root.rstrip("/") + "/"), slug(name), F.lit("-"), slug(version), F.lit("-"), dataset_id)


def workspace(provider: Column, url: Column, version: Column) -> Column:
    """Incoming folder name of a download."""
    last = F.regexp_extract(F.regexp_replace(url, "/+$", ""), "([^/]*)$", 1)
    return F.concat(F.lit("download-"), provider, F.lit("-"), slug(last), F.lit("-"), slug(version))


def ingest_log(name: Column, version: Column) -> Column:
    return F.concat(F.lit("ingest-"), slug(name), F.lit("-"), slug(version), F.lit(".log"))


def managed_mode(kind: Column, mode: Column) -> Column:
    """Access mode of an entry in managed storage; null leaves a link untouched."""
    return (
        F.when(kind == "symlink", F.lit(None).cast("int"))
        .when(kind == "dir", F.lit(vocab.MANAGED_DIRECTORY_MODE))
        .when(mode.bitwiseAND(F.lit(vocab.EXECUTE_BITS)) != 0, F.lit(vocab.MANAGED_EXECUTABLE_MODE))
        .otherwise(F.lit(vocab.MANAGED_FILE_MODE))
    )


def public_mode(kind: Column, mode: Column) -> Column:
    """Access mode that publishes an entry kept at its place; null leaves a link untouched."""
    return (
        F.when(kind == "symlink", F.lit(None).cast("int"))
        .when(kind == "dir", mode.bitwiseOR(F.lit(vocab.PUBLIC_DIRECTORY_BITS)))
        .otherwise(mode.bitwiseOR(F.lit(vocab.PUBLIC_FILE_BITS)))
    )


def is_below(path: Column, root: Column | str) -> Column:
    """Whether a path is the root or lies under it, by whole segments."""
    base = F.lit(root) if isinstance(root, str) else root
    return (path == base) | path.startswith(F.concat(F.rtrim(base, F.lit("/")), F.lit("/")))
