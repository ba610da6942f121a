"""Registry tables on disk: versioned writes, declared reads, documents and problem logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import schemas
from shelfmark.operators.search import alias_rollup, serialize_datasets


def write_version(tables: dict[str, DataFrame], root: str, version: int) -> str:
    """Write one registry version: all tables below one folder, then the pointer to it.

    Readers follow the pointer, so they see either the old tables or all new ones.
    """
    spark = next(iter(tables.values())).sparkSession
    folder = f"{root}/v{version:08d}"
    for name, df in tables.items():
        declared = schemas.REGISTRY_TABLES[name]
        df.select(*[F.col(f.name).cast(f.dataType) for f in declared]).write.mode("errorifexists").parquet(f"{folder}/{name}")
    spark.createDataFrame([(version,)], "version bigint").coalesce(1).write.mode("overwrite").parquet(f"{root}/_current/v{version:08d}")
    return folder


def current_version(spark: SparkSession, root: str) -> int:
    """Newest completely written version: its pointer is written last."""
    found = spark.read.schema("version bigint").option("recursiveFileLookup", "true").parquet(f"{root}/_current")
    return found.agg(F.max("version")).first()[0]


def read_table(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """One registry table with its declared schema."""
    chosen = current_version(spark, root) if version is None else version
    return spark.read.schema(schemas.REGISTRY_TABLES[name]).parquet(f"{root}/v{chosen:08d}/{name}")


def next_state(current: DataFrame, changed: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Current rows with the changed ones put in their place."""
    return current.join(changed.select(key), key, "left_anti").unionByName(changed.select(*current.columns))


class SchemaUpgradeError(ValueError):
    """A table with rows lacks a required column that has no default."""


def reconcile_schema(old: DataFrame, table: str, declared: T.StructType | None = None,
                     defaults: dict | None = None, required: list[str] | None = None) -> DataFrame:
    """Bring an older table to the declared schema.

    Missing columns are added with their default or null, retired columns stay as nullable
    columns behind the current ones. A required column without default is refused when the
    table has rows.
    """
    declared = declared or schemas.REGISTRY_TABLES[table]
    defaults = schemas.COLUMN_DEFAULTS.get(table, {}) if defaults is None else defaults
    required = schemas.REQUIRED_COLUMNS.get(table, []) if required is None else required
    present = set(old.columns)
    unfillable = [f.name for f in declared if f.name not in present and f.name in required and f.name not in defaults]
    if unfillable and not old.isEmpty():
        raise SchemaUpgradeError(f"table {table!r} has rows; new required columns {', '.join(unfillable)} need a default")
    columns = []
    for field in declared:
        default = defaults.get(field.name)
        if isinstance(default, list):
            fallback = F.array(*[F.lit(v) for v in default]).cast(field.dataType)
        else:
            fallback = F.lit(default).cast(field.dataType)
        # A default fills a column the old table lacks; a null it already holds stays.
        value = F.col(field.name).cast(field.dataType) if field.name in present else fallback
        columns.append(value.alias(field.name))
    names = {f.name for f in declared}
    retired = [F.col(c) for c in old.columns if c not in names]
    return old.select(*columns, *retired)


def append_to_reconciled(reconciled: DataFrame, added: DataFrame) -> DataFrame:
    """Add current rows below reconciled ones; retired columns are null for them."""
    return reconciled.unionByName(added, allowMissingColumns=True)


def manifest_documents(datasets: DataFrame, aliases: DataFrame) -> DataFrame:
    """JSON documents of two kinds, nulls written out: one per dataset, and one per alias of it."""
    written = {"ignoreNullFields": "false"}
    fields = ["dataset_id", "name", "provider", "source_url", "version", "modalities", "size_bytes", "status",
              "storage_path", "storage_mode"]
    records = serialize_datasets(datasets, aliases).select(
        "dataset_id", F.to_json(F.struct(F.lit("dataset").alias("record"), *fields), written).alias("document"),
        F.lit("").alias("kind"), F.lit("").alias("value"),
    )
    return records.unionByName(alias_rollup(aliases).select(
        "dataset_id", F.to_json(F.struct(F.lit("alias").alias("record"), "dataset_id", "kind", "value"), written).alias("document"),
        "kind", "value",
    ))


def write_documents(documents: DataFrame, path: str) -> None:
    """Write documents as JSON lines over range partitions: each dataset, then its aliases in order."""
    order = ["dataset_id", "kind", "value"]
    documents.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.col("document").alias("value")
    ).write.mode("errorifexists").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.get_json_object("value", "$.dataset_id").alias("dataset_id"), F.col("value").alias("document")
    )


PROBLEM_FIELDS = ["dataset_id", "health_check_id", "message", "name", "result", "storage_path", "timestamp"]
PROBLEM_SCHEMA = ", ".join(f"{name} string" for name in PROBLEM_FIELDS)


def append_problems(problems: DataFrame, path: str) -> None:
    """Append problem records as JSON lines with their keys in order."""
    problems.select(
        F.to_json(F.struct(*PROBLEM_FIELDS), {"ignoreNullFields": "false"}).alias("value")
    ).write.mode("append").text(path)


def read_problems(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROBLEM_SCHEMA).json(path)
