"""Structured Streaming forms of the append-only logs, histories and gates.

Every job takes a stream and a target folder on shared storage, runs until its input is used up
(``availableNow``) or for good with ``trigger``, and writes files, so nothing passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.operators.intake import register_against
from shelfmark.session import cut_lineage, ship_package
from shelfmark.sources.logs import redacted_events
from shelfmark.streaming.keyed import Cooldown
from shelfmark.streaming.owner_index import OwnerIndex

#: How much later than newer events an event may come.
LATE = "7 days"
#: Groups of environments whose state is kept together; a batch costs a call of the workers for each, not for each environment.
GROUPS = 4096


def _run(stream: DataFrame, target: str, each_batch: Callable[[DataFrame, int], None], trigger: dict | None = None):
    query = (
        stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", f"{target}/_progress")
        .trigger(**(trigger or {"availableNow": True})).start()
    )
    if trigger is None:
        query.awaitTermination()
    return query


def stream_redacted_logs(lines: DataFrame, target: str, trigger: dict | None = None):
    """Append redacted events of a log-line stream."""
    query = (
        redacted_events(lines).writeStream.format("parquet").option("path", f"{target}/out")
        .option("checkpointLocation", f"{target}/_progress").outputMode("append")
        .trigger(**(trigger or {"availableNow": True})).start()
    )
    if trigger is None:
        query.awaitTermination()
    return query


def stream_problem_alerts(history: DataFrame, target: str, trigger: dict | None = None):
    """Append problems of a health history stream as JSON lines."""
    problems = history.filter(F.col("result").isin(vocab.PROBLEM_RESULTS)).select(
        F.to_json(F.struct("check_id", "dataset_id", "message", "result")).alias("value")
    )
    query = (
        problems.writeStream.format("text").option("path", f"{target}/out")
        .option("checkpointLocation", f"{target}/_progress").outputMode("append")
        .trigger(**(trigger or {"availableNow": True})).start()
    )
    if trigger is None:
        query.awaitTermination()
    return query


def _batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def stream_cooldown_gate(
    events: DataFrame, target: str, cooldown: int = vocab.HEALTH_COOLDOWN_SECONDS, late: str = LATE, trigger: dict | None = None
):
    """Keep an event per environment and cooldown: ``environment`` and ``ts``, appended below ``out``.

    State is one time per environment, dropped when the watermark has passed the cooldown after it,
    as no event can then be refused for it; environments share ``GROUPS`` values by their hash. Events that come more than ``late`` after newer ones are
    not considered, and none at or before the epoch is. A batch reads its own events and the state of
    their environments, and a batch that runs again after a failure writes the same rows.
    """
    _keyed_state(events.sparkSession)
    kept = (
        events.select("environment", "ts").filter("ts is not null").withWatermark("ts", late)
        .withColumn("group", F.pmod(F.xxhash64("environment"), F.lit(GROUPS))).groupBy("group")
        .transformWithStateInPandas(Cooldown(cooldown), "environment string, ts timestamp", "Append", "EventTime")
    )
    query = (
        kept.writeStream.format("parquet").option("path", f"{target}/out").option("checkpointLocation", f"{target}/_progress")
        .outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    )
    if trigger is None:
        query.awaitTermination()
    return query


def _keyed_state(spark: SparkSession) -> None:
    """State off the heap, one store per shuffle partition; the workers get the package that runs on it."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    ship_package(spark)


def stream_intake_gate(requests: DataFrame, target: str, trigger: dict | None = None):
    """Register a stream of intake requests; every batch meets the registry its forerunners left.

    The registry is met through the index of who holds which key, so a batch reads the buckets of
    its own keys. Each batch writes its additions under its own number, so a batch that is run again
    after a failure replaces its first try.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        index = OwnerIndex(batch.sparkSession, f"{target}/owners")
        change = register_against(batch, lambda keys: index.lookup(keys, batch_id))
        datasets, aliases = cut_lineage(change.datasets), cut_lineage(change.aliases)
        datasets.write.mode("overwrite").parquet(_batch_folder(f"{target}/datasets", batch_id))
        aliases.write.mode("overwrite").parquet(_batch_folder(f"{target}/dataset_aliases", batch_id))
        change.outcomes.write.mode("overwrite").parquet(_batch_folder(f"{target}/outcomes", batch_id))
        index.append(datasets, aliases, batch_id)

    return _run(requests, target, each, trigger)


def seed_intake_registry(datasets: DataFrame, aliases: DataFrame, target: str) -> None:
    """Put the registry an intake stream starts from below its target, before batch 0, and index its keys."""
    datasets.write.mode("overwrite").parquet(_batch_folder(f"{target}/datasets", -1))
    aliases.write.mode("overwrite").parquet(_batch_folder(f"{target}/dataset_aliases", -1))
    OwnerIndex(datasets.sparkSession, f"{target}/owners").seed(datasets, aliases)


def stream_latest_status(history: DataFrame, target: str, trigger: dict | None = None):
    """Newest status per dataset of a history stream, each change appended with its batch."""
    newest = history.groupBy("dataset_id").agg(
        F.max(F.struct("started_at", "check_id", "result", "resulting_status")).alias("newest")
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.select("dataset_id", "newest.*").write.mode("overwrite").parquet(_batch_folder(f"{target}/out", batch_id))

    query = (
        newest.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{target}/_progress")
        .trigger(**(trigger or {"availableNow": True})).start()
    )
    if trigger is None:
        query.awaitTermination()
    return query


STATUS_SCHEMA = "dataset_id string, started_at timestamp, check_id string, result string, resulting_status string, batch_id bigint"


def read_latest_status(spark: SparkSession, target: str) -> DataFrame:
    """Current status per dataset from what the stream has written so far."""
    written = spark.read.schema(STATUS_SCHEMA).parquet(f"{target}/out")
    last = written.groupBy("dataset_id").agg(
        F.max(F.struct("batch_id", "check_id", "result", "resulting_status")).alias("last")
    )
    return last.select("dataset_id", "last.check_id", "last.result", "last.resulting_status")
