"""Time gates: at most one run per environment and cooldown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.session import counted_cut, cut_lineage


def cooldown_gate(
    events: DataFrame,
    key: str = "environment",
    ts: str = "ts",
    cooldown: int = vocab.HEALTH_COOLDOWN_SECONDS,
    previous: DataFrame | None = None,
) -> DataFrame:
    """Events kept when each must lie a full cooldown after the last *kept* event of its key.

    Each event points to the first event at least a cooldown later; kept are those that can be
    reached from a key's first event. They are marked by pointer doubling: round k knows the
    first 2^k of them, so the rounds grow with the logarithm of the number kept, and no round
    brings the events of a key together. ``previous`` (key, last) is what earlier batches kept.
    """
    width = cooldown * 1_000_000
    times = cut_lineage(events.filter(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(F.col(ts)).alias("at")).distinct())
    open_times = times
    if previous is not None:
        before = previous.groupBy(F.col(key).alias("key")).agg(F.max(F.unix_micros("last")).alias("last"))
        open_times = times.join(before, "key", "left").filter(F.col("last").isNull() | (F.col("at") >= F.col("last") + width)).drop("last")
    front = cut_lineage(open_times.groupBy("key").agg(F.min("at").alias("at")))
    reached = front
    jumps, left = counted_cut(_next_events(times, width).filter("next is not null"))
    while left:
        # After k rounds the first 2^k kept events are known and jumps are 2^k long, so what they reach is new.
        ahead, new = counted_cut(reached.join(jumps, ["key", "at"]).select("key", F.col("next").alias("at")))
        if not new:
            break
        reached = reached.unionByName(ahead)
        further = jumps.select("key", F.col("at").alias("next"), F.col("next").alias("after"))
        jumps, left = counted_cut(jumps.join(further, ["key", "next"]).select("key", "at", F.col("after").alias("next")))
    return reached.select(F.col("key").alias(key), F.timestamp_micros("at").alias(ts))


def _next_events(times: DataFrame, width: int) -> DataFrame:
    """(key, at, next): the first event at least ``width`` later.

    Events and the times they ask for are sorted together, by key and time, into slices of the
    whole, so a key with all its events in one cooldown lies in as many slices as it fills. Inside a
    slice the next event follows; a time with none after it there takes the first event of the key
    in a later slice, for which each slice of a key gives one row.
    """
    asked = times.select("key", (F.col("at") + width).alias("time"), F.col("at").alias("asker"))
    marks = times.select("key", F.col("at").alias("time"), F.lit(None).cast("bigint").alias("asker")).unionByName(asked)
    slices = int(times.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = cut_lineage(marks.repartitionByRange(slices, "key", "time", "asker").withColumn("slice", F.spark_partition_id()))
    # Backwards in time the last event seen is the next one; an event at the very time counts.
    event = F.when(F.col("asker").isNull(), F.col("time"))
    back = W.partitionBy("slice", "key").orderBy(F.desc("time"), F.col("asker").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = sliced.withColumn("inside", F.last(event, ignorenulls=True).over(back)).filter("asker is not null")
    firsts = sliced.groupBy("key", "slice").agg(F.min(event).alias("first"))
    after = W.partitionBy("key").orderBy(F.desc("slice")).rowsBetween(W.unboundedPreceding, -1)
    later = firsts.select("key", "slice", F.last("first", ignorenulls=True).over(after).alias("later"))
    return found.join(later, ["key", "slice"]).select(
        "key", F.col("asker").alias("at"), F.coalesce("inside", "later").alias("next")
    )
