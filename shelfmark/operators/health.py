"""Health classification of datasets from inventories, inspections and repairs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.functions.tables import first_per_key
from shelfmark.operators.inventory import inventory_facts, missing_content_summary, payload_markers

UNAVAILABLE = ("missing", "broken")


def _check_facts(datasets: DataFrame, inventory: DataFrame, deep: bool, roots: DataFrame | None) -> DataFrame:
    """Datasets with what their inventory says; sizes are only gathered for deep checks.

    ``is_directory`` is what ``roots`` (dataset_id, is_directory) says of the storage path; without
    it, a path is a directory if anything is listed below it.
    """
    facts = datasets.join(inventory_facts(inventory) if deep else payload_markers(inventory), "dataset_id", "left")
    listed = F.col("entries").isNotNull()
    if roots is None:
        return facts.withColumn("is_directory", listed)
    known = roots.select("dataset_id", F.col("is_directory").alias("root_is_directory"))
    return facts.join(known, "dataset_id", "left").withColumn("is_directory", F.coalesce("root_is_directory", listed))


def _missing_reason():
    return (
        F.when(F.col("storage_path").isNull(), vocab.NO_STORAGE_PATH)
        .when(~F.col("is_directory"), F.concat(F.lit(vocab.NO_DIRECTORY), "storage_path"))
        .when(~F.coalesce("has_payload", F.lit(False)), F.concat(F.lit(vocab.NO_PAYLOAD), "storage_path"))
    )


def health_check(
    datasets: DataFrame, inventory: DataFrame, inspections: DataFrame, repairs: DataFrame | None = None, roots: DataFrame | None = None
) -> DataFrame:
    """Deep check of every dataset: result, next status, size and message.

    ``inspections`` is (dataset_id, tool_present, error, size_error): whether the annex tool ran
    and whether sizes could be read. ``repairs`` is (dataset_id, tool_present, exit_code, error,
    missing_after, recheck_error) for checkouts with missing content, perhaps with the ``remaining``
    paths that the message then names; without it such a checkout is ``broken`` with repair still to
    come. ``roots`` is (dataset_id, is_directory): an empty directory is told from an absent one.
    """
    facts = (
        _check_facts(datasets, inventory, deep=True, roots=roots)
        .join(missing_content_summary(inventory).select("dataset_id", "missing", F.col("message").alias("missing_message")), "dataset_id", "left")
        .join(inspections, "dataset_id", "left")
    )
    gone = _missing_reason()
    tool = F.coalesce("tool_present", F.lit(True))
    verdict = (
        F.when(gone.isNotNull(), "missing").when(~F.col("is_checkout"), "plain").when(~tool, "no tool")
        .when(F.col("error").isNotNull(), "uninspected").when(F.col("missing").isNull(), "complete").otherwise("incomplete")
    )
    judged = facts.withColumn("gone", gone).withColumn("verdict", verdict)
    if repairs is not None:
        judged = judged.join(
            repairs.select(
                "dataset_id", F.col("tool_present").alias("repair_tool"), "exit_code", F.col("error").alias("repair_error"),
                "missing_after", "recheck_error", (F.col("remaining") if "remaining" in repairs.columns else F.lit(None).cast("string")).alias("remaining"),
            ), "dataset_id", "left",
        )
        repair = (
            F.when(~F.col("repair_tool"), "no repair tool")
            .when((F.col("exit_code") != 0) | F.col("repair_error").isNotNull(), "repair failed")
            .when(F.col("recheck_error").isNotNull(), "recheck failed")
            .when(F.col("missing_after") > 0, "still missing")
            .when(F.col("missing_after") == 0, "repaired")
        )
        judged = judged.withColumn("repair", F.when(F.col("verdict") == "incomplete", repair))
    else:
        judged = judged.withColumn("repair", F.lit(None).cast("string")).withColumn("repair_error", F.lit(None).cast("string")).withColumn(
            "recheck_error", F.lit(None).cast("string")).withColumn("remaining", F.lit(None).cast("string"))
    return _decided(judged)


def _decided(judged: DataFrame) -> DataFrame:
    """Turn verdicts into result, status, size, message and repair flags, in one ordered choice each."""
    verdict, repair = F.col("verdict"), F.col("repair")
    repaired = F.coalesce(repair == "repaired", F.lit(False))
    sound = verdict.isin("plain", "complete") | repaired
    size_failed = sound & F.col("size_error").isNotNull()
    result = (
        F.when(size_failed, "error").when(sound, "healthy").when(verdict == "missing", "missing")
        .when(verdict.isin("no tool", "uninspected"), "error").otherwise("broken")
    )
    status = (
        # A checkout found incomplete was marked broken before its repair; a failed size read keeps that.
        F.when(size_failed & (verdict == "incomplete"), "broken")
        .when(size_failed, F.col("status"))
        .when(verdict == "plain", F.when(F.col("status").isin(*UNAVAILABLE), "available").otherwise(F.col("status")))
        .when(sound, "available").when(verdict == "missing", "missing")
        .when(verdict == "incomplete", "broken").otherwise(F.col("status"))
    )
    message = (
        F.when(verdict == "missing", F.col("gone"))
        .when(size_failed, F.concat(F.lit(vocab.SIZE_FAILED), "size_error"))
        .when(verdict == "plain", vocab.HAS_PAYLOAD)
        .when(verdict == "no tool", vocab.NO_INSPECTION_TOOL)
        .when(verdict == "uninspected", F.concat(F.lit(vocab.NOT_INSPECTED), "error"))
        .when(verdict == "complete", vocab.CONTENT_PRESENT)
        .when(repaired, vocab.REPAIRED)
        .when(repair == "no repair tool", F.concat("missing_message", F.lit(vocab.NO_REPAIR_TOOL)))
        .when(repair == "repair failed", F.concat("missing_message", F.lit(vocab.REPAIR_FAILED), F.coalesce("repair_error", F.lit(""))))
        .when(repair == "recheck failed", F.concat(
            "missing_message", F.lit(vocab.RECHECK_FAILED), "recheck_error"))
        .when(repair == "still missing", F.concat(
            "missing_message", F.lit(vocab.STILL_ABSENT), F.coalesce(F.concat(F.lit(": "), "remaining"), F.lit(""))))
        .otherwise(F.col("missing_message"))
    )
    refreshed = sound & ~size_failed
    attempted = F.coalesce(~repair.isin("no repair tool"), F.lit(False))
    return judged.select(
        "dataset_id", "name", "storage_path", F.col("status").alias("previous_status"), result.alias("result"), status.alias("resulting_status"),
        F.when(refreshed, F.coalesce("total_bytes", F.lit(0))).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.when(refreshed, F.lit(True)).otherwise(F.col("size_bytes_known")).alias("size_bytes_known"),
        message.alias("message"), attempted.alias("repair_attempted"), F.when(attempted, repaired).alias("repair_succeeded"),
    ).withColumn("log_problem", F.col("result").isin(vocab.PROBLEM_RESULTS))


def repair_outcomes(
    datasets: DataFrame, inventory: DataFrame, inspections: DataFrame, repairs: DataFrame, roots: DataFrame | None = None
) -> DataFrame:
    """Checks that went into a repair, with its outcome."""
    return health_check(datasets, inventory, inspections, repairs, roots).filter(
        "repair_attempted or message like '%repair could not start%'"
    )


def quick_check_flags(datasets: DataFrame, inventory: DataFrame, running: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Query-time check without sizes: immediate result, warning and whether repair is under way.

    ``running`` is (dataset_id): checks of these meet another worker and are ``skipped``.
    """
    facts = _check_facts(datasets, inventory, deep=False, roots=roots).join(
        running.select("dataset_id").distinct().withColumn("busy", F.lit(True)), "dataset_id", "left"
    )
    gone = _missing_reason()
    judged = facts.withColumn("gone", gone)
    unavailable = F.col("status").isin(*UNAVAILABLE)
    deferred = F.col("gone").isNull() & F.col("is_checkout")
    result = (
        F.when(F.col("gone").isNotNull(), "missing").when(~F.col("is_checkout"), "healthy")
        .when(F.col("busy"), "skipped").otherwise("running")
    )
    status = F.when(F.col("gone").isNotNull(), "missing").when(~F.col("is_checkout") & unavailable, "available").otherwise(F.col("status"))
    warning = F.coalesce("gone", F.when(
        deferred & unavailable,
        vocab.VERIFYING,
    ))
    return judged.select(
        "dataset_id", result.alias("result"), status.alias("status"), warning.alias("warning"),
        (deferred & unavailable).alias("repair_in_progress"), deferred.alias("needs_verification"),
    )


class HealthChange(NamedTuple):
    datasets: DataFrame
    history: DataFrame
    problems: DataFrame


def apply_health(datasets: DataFrame, checks: DataFrame, run_id: str, completed_at: str) -> HealthChange:
    """Next dataset rows, history rows and problem records of a round of checks."""
    at = F.lit(completed_at).cast("timestamp")
    update = checks.select(
        "dataset_id", F.col("resulting_status").alias("new_status"), F.col("size_bytes").alias("new_size"), F.col("size_bytes_known").alias("new_known"),
    )
    next_rows = datasets.join(update, "dataset_id", "left").select(
        *[F.col(c) for c in ("dataset_id", "name", "provider", "source_url", "version", "modalities")],
        F.coalesce("new_size", "size_bytes").alias("size_bytes"), F.coalesce("new_known", "size_bytes_known").alias("size_bytes_known"),
        F.coalesce("new_status", "status").alias("status"), "storage_path", "storage_mode", "created_at",
    )
    check_id = F.concat(F.lit(run_id + "-"), "dataset_id")
    history = checks.select(
        check_id.alias("check_id"), "dataset_id", "result", "previous_status", "resulting_status", "message",
        "repair_attempted", "repair_succeeded", at.alias("started_at"), at.alias("completed_at"),
    )
    problems = checks.filter("log_problem").select(
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), "dataset_id", "name", "storage_path",
        check_id.alias("health_check_id"), "result", "message",
    )
    return HealthChange(next_rows, history, problems)


def latest_health(history: DataFrame) -> DataFrame:
    """Newest check of every dataset."""
    return first_per_key(history, ["dataset_id"], [F.col("started_at").desc(), F.col("check_id").desc()])


def health_problems(datasets: DataFrame, history: DataFrame) -> DataFrame:
    """Datasets whose newest check found a problem."""
    return latest_health(history).filter(F.col("result").isin(vocab.PROBLEM_RESULTS)).join(
        datasets.select("dataset_id", "name"), "dataset_id"
    ).select("dataset_id", "name", "check_id", "result", "message")
