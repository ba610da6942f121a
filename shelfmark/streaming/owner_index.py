"""Who holds which key, as an append-only table in hash buckets that a stream of requests looks up.

The table has a base and, after it, one delta per batch. A lookup reads the buckets its keys fall
into and nothing else. Every ``EVERY`` batches base and deltas become the next base, so that a
lookup never meets more deltas than that; which base a batch starts from follows from its number,
so a batch that runs again reads and writes the same folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.conflicts import owner_keys
from shelfmark.session import cut_lineage

#: Hash buckets of the table; each is one folder of a base or delta.
BUCKETS = 64
#: Batches after which deltas are merged.
EVERY = 16
SCHEMA = "key string, created_at timestamp, dataset_id string, bucket int"


def held_keys(datasets: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, created_at, dataset_id) of every identity, and of every stored alias value below ``value|``."""
    values = aliases.join(datasets.select("dataset_id", "created_at"), "dataset_id").select(
        F.concat(F.lit("value|"), "value").alias("key"), "created_at", "dataset_id"
    )
    return owner_keys(datasets, aliases).select("key", "created_at", "dataset_id").unionByName(values)


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _newest(rows: DataFrame) -> DataFrame:
    """One row per key, its newest holder; combined in the map tasks, so a key with many holders gathers nowhere."""
    last = rows.groupBy("key").agg(F.max(F.struct("created_at", "dataset_id")).alias("owner"))
    return last.select("key", "owner.created_at", "owner.dataset_id")


class OwnerIndex:
    """The table below a folder; batches are numbered from 0."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def seed(self, datasets: DataFrame, aliases: DataFrame) -> None:
        """The base of batch 0."""
        self._write(held_keys(datasets, aliases), self._base(0))

    def append(self, datasets: DataFrame, aliases: DataFrame, batch_id: int) -> None:
        """What a batch adds; a batch that runs again replaces its first try."""
        self._write(held_keys(datasets, aliases), self._delta(batch_id))

    def lookup(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """(key, owner) of those of ``keys`` that are held before a batch."""
        self._merge(batch_id)
        asked = cut_lineage(keys.select("key").distinct().withColumn("bucket", _bucket(F.col("key"))))
        touched = [row["bucket"] for row in asked.select("bucket").distinct().collect()]  # at most BUCKETS
        held = self._before(batch_id).filter(F.col("bucket").isin(touched)).join(asked, ["bucket", "key"], "left_semi")
        return _newest(held).select("key", F.struct("created_at", "dataset_id").alias("owner"))

    def _base(self, batch_id: int) -> str:
        return f"{self.root}/base-{batch_id // EVERY * EVERY}"

    def _delta(self, batch_id: int) -> str:
        return f"{self.root}/delta-{batch_id}"

    def _write(self, rows: DataFrame, path: str) -> None:
        placed = _newest(rows).withColumn("bucket", _bucket(F.col("key")))
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def _before(self, batch_id: int) -> DataFrame:
        """Rows that earlier batches left: a base and the deltas after it."""
        read = lambda path: self.spark.read.schema(SCHEMA).parquet(path)
        rows = read(self._base(batch_id))
        for earlier in range(batch_id // EVERY * EVERY, batch_id):
            rows = rows.unionByName(read(self._delta(earlier)))
        return rows

    def _merge(self, batch_id: int) -> None:
        """Write the base a batch is the first to start from, and drop what no batch can need any more."""
        if batch_id == 0 or batch_id % EVERY:
            return
        rows = self.spark.read.schema(SCHEMA).parquet(self._base(batch_id - 1))
        for earlier in range(batch_id - EVERY, batch_id):
            rows = rows.unionByName(self.spark.read.schema(SCHEMA).parquet(self._delta(earlier)))
        self._write(rows.drop("bucket"), self._base(batch_id))
        if batch_id >= 2 * EVERY:
            # The batch before may run again, not those before its base.
            self._drop(self._base(batch_id - 2 * EVERY), *[self._delta(k) for k in range(batch_id - 2 * EVERY, batch_id - EVERY)])

    def _drop(self, *paths: str) -> None:
        for name in paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
