"""Run logs: text lines to typed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log files as (source, line)."""
    return spark.read.text(path).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source"), F.col("value").alias("line")
    )


def parse_run_logs(lines: DataFrame) -> DataFrame:
    """Lines with timestamp, level, event and fields; continuation lines keep a null level.

    Diagnostic lines carry a level and an event, intake lines an action; both come out alike.
    A field's value runs up to the next ``key=``; of a repeated key the first one is the event's own.
    """
    line = F.col("line")
    is_event = line.rlike(text.EVENT_LINE)
    is_action = ~is_event & line.rlike(text.INGEST_LINE)

    def part(event_group: int, action_group: int) -> Column:
        return F.when(is_event, F.regexp_extract(line, text.EVENT_LINE, event_group)).when(
            is_action, F.regexp_extract(line, text.INGEST_LINE, action_group)
        )

    staged = lines.select(
        *lines.columns,
        part(1, 1).alias("ts_text"),
        F.when(is_event, F.regexp_extract(line, text.EVENT_LINE, 2)).alias("level"),
        part(3, 2).alias("event"),
        F.split(part(4, 3), text.BEFORE_FIELD).alias("_pieces"),
    )
    whole = F.filter("_pieces", lambda p: p.rlike(r"^\w+="))
    entries = F.transform(whole, lambda p: F.struct(
        F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(p, r"^\w+=", "").alias("value")
    ))
    own = text.bound(entries, lambda held: F.filter(
        held, lambda e, i: F.array_position(F.transform(held, lambda other: other["key"]), e["key"]) == i + 1
    ))
    return staged.select(
        *lines.columns, "ts_text", F.try_to_timestamp("ts_text").alias("ts"), "level", "event",
        F.map_from_entries(own).alias("fields"),
    )


def redacted_events(lines: DataFrame) -> DataFrame:
    """Parsed events with every secret removed, as the line a log may keep."""
    parsed = parse_run_logs(lines)
    clean = text.redact_fields(F.col("fields"))
    return parsed.select(
        *lines.columns[:-1], "ts_text", "level", "event",
        F.when(F.col("event").isNull(), text.redact(F.col("line"))).otherwise(text.render_fields(clean)).alias("content"),
    )
