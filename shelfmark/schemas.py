"""Declared schemas of the catalog tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
}


def _table(columns: str) -> T.StructType:
    """Schema of ``name type`` pairs; needs no running session, so tasks can import this module."""
    pairs = [column.split() for column in columns.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


DATASETS = _table(
    "dataset_id string, name string, provider string, source_url string, version string, "
    "modalities array<string>, size_bytes bigint, size_bytes_known boolean, status string, "
    "storage_path string, storage_mode string, created_at timestamp"
)
DATASET_ALIASES = _table("dataset_id string, kind string, value string")
INGESTION_JOBS = _table(
    "job_id string, dataset_id string, status string, mode string, message string, created_at timestamp"
)
HEALTH_HISTORY = _table(
    "check_id string, dataset_id string, result string, previous_status string, resulting_status string, "
    "message string, repair_attempted boolean, repair_succeeded boolean, started_at timestamp, "
    "completed_at timestamp"
)
FILE_INVENTORY = _table(
    "dataset_id string, relative_path string, kind string, target_kind string, dev bigint, ino bigint, "
    "size bigint, mode int, uid bigint, is_dangling boolean, content_present boolean, checksum string"
)
MANIFEST_FILES = _table(
    "source_id string, relative_path string, size bigint, download_url string, checksum string"
)

REGISTRY_TABLES = {
    "datasets": DATASETS,
    "dataset_aliases": DATASET_ALIASES,
    "ingestion_jobs": INGESTION_JOBS,
    "health_history": HEALTH_HISTORY,
}

# Columns a current registry table must have a value for, and the value an older row receives.
# A required column without an entry here cannot be added to a table that has rows.
COLUMN_DEFAULTS = {
    "datasets": {
        "version": "unknown",
        "modalities": [],
        "size_bytes": 0,
        "size_bytes_known": True,
        "status": "ingesting",
        "storage_mode": "reference",
    },
    "dataset_aliases": {},
    "ingestion_jobs": {"status": "pending"},
    "health_history": {"result": "running", "repair_attempted": False},
}
REQUIRED_COLUMNS = {
    "datasets": ["dataset_id", "name", "provider", "version", "modalities", "size_bytes",
                 "size_bytes_known", "status", "storage_mode"],
    "dataset_aliases": ["dataset_id", "kind", "value"],
    "ingestion_jobs": ["job_id", "status", "mode"],
    "health_history": ["check_id", "dataset_id", "result", "previous_status", "repair_attempted"],
}
