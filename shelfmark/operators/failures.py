"""Failure classification, retry planning and run outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.functions.text import redact
from shelfmark.functions.values import strip

SEQUENCE_BLOCK = 4096

# Fixed value: an HTTP date, day name and seconds optional, year of two or four digits, then a zone.
HTTP_DATE = (
    r"^(?:[A-Za-z]+,\s*)?(\d{1,2})[ -]([A-Za-z]{3})[ -](\d{4}|\d{2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?"
    r"(?:\s+([+-]\d{4}|[A-Za-z]+))?$"
)
# Fixed value: the same moment in the order of C's asctime, which has no zone.
ASCTIME_DATE = r"^(?:[A-Za-z]+,?\s+)?([A-Za-z]{3})\s+(\d{1,2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s+(\d{4}|\d{2})$"
# Hours of the zone names that mail and HTTP dates know; other names count as UTC.
ZONE_HOURS = {"AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}


def any_of(markers: list[str]) -> str:
    """Pattern that finds any of the markers; they hold no special characters."""
    return "|".join(markers)


def _chain_has(chain: Column, test) -> Column:
    return F.coalesce(F.exists(chain, lambda e: F.coalesce(test(e), F.lit(False))), F.lit(False))


def retry_after_seconds(value: Column, now: str) -> Column:
    """Delay a Retry-After header asks for: a number, or an HTTP date seen from ``now``; never negative."""
    text = strip(value)
    is_asctime = text.rlike(ASCTIME_DATE)

    def part(group: int, of_asctime: int | None) -> Column:
        usual = F.regexp_extract(text, HTTP_DATE, group)
        return usual if of_asctime is None else F.when(is_asctime, F.regexp_extract(text, ASCTIME_DATE, of_asctime)).otherwise(usual)

    day, month, written = part(1, 2), part(2, 1), part(3, 6)
    hour, minute, second, zone = part(4, 3), part(5, 4), part(6, 5), part(7, None)
    short = written.try_cast("int")
    # Two-digit years from 69 on are of the last century.
    year = F.when(F.length(written) > 2, short).when(short >= 69, short + 1900).otherwise(short + 2000)
    at = F.try_to_timestamp(
        F.concat_ws(" ", day, F.initcap(month), year.cast("string"), F.concat_ws(":", hour, minute, F.when(second == "", "00").otherwise(second))),
        F.lit("d MMM yyyy HH:mm:ss"),
    )
    named = F.coalesce(*[F.when(F.upper(zone) == name, F.lit(hours * 3600)) for name, hours in ZONE_HOURS.items()], F.lit(0))
    offset = F.when(zone.rlike(r"^[+-]\d{4}$"), F.concat(F.left(zone, F.lit(1)), F.lit("1")).try_cast("int") * (
        F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 4, 2).try_cast("int") * 60
    )).otherwise(named)
    dated = F.when(is_asctime | text.rlike(HTTP_DATE), F.unix_timestamp(at) - offset)
    until = dated - F.unix_timestamp(F.lit(now).cast("timestamp"))
    plain = F.lower(strip(value))
    number = F.when(plain.rlike(r"^[+-]?nan$"), F.lit(0.0)).when(
        plain.rlike(r"^[+]?inf(inity)?$"), F.lit(float("inf"))).when(plain.rlike(r"^-inf(inity)?$"), F.lit(0.0)).when(
        plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), plain.try_cast("double")
    )
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), number)).when(
        until.isNotNull(), F.greatest(F.lit(0.0), until.cast("double"))
    )


def with_decision(attempts: DataFrame, now: str) -> DataFrame:
    """Attempts with category, retryable, rotate_node and retry_after, by ordered rules.

    Every rule looks at the whole error chain before the next rule is asked: terminal texts,
    statuses, node availability, network types, and at last the texts of a network failure.
    """
    chain = F.col("chain")
    terminal_text = _chain_has(chain, lambda e: F.lower(e["message"]).rlike(any_of(vocab.TERMINAL_ERROR_TEXTS)))
    network_text = F.col("transport").isin(vocab.TEXT_MATCHED_TRANSPORTS) & _chain_has(
        chain,
        lambda e: ~e["type"].isin(vocab.LOCAL_FILE_ERROR_TYPES) & F.lower(e["message"]).rlike(any_of(vocab.NETWORK_ERROR_TEXTS)),
    )
    category = (
        F.when(terminal_text, "terminal")
        .when(_chain_has(chain, lambda e: e["http_status"].isin(vocab.TERMINAL_HTTP_STATUSES)), "terminal")
        .when(_chain_has(chain, lambda e: e["http_status"] == vocab.RATE_LIMIT_HTTP_STATUS), "rate_limit")
        .when(_chain_has(chain, lambda e: e["http_status"].isin(vocab.NETWORK_HTTP_STATUSES)), "network")
        .when(_chain_has(chain, lambda e: e["http_status"].between(500, 599)), "server")
        .when(_chain_has(chain, lambda e: e["type"].isin(vocab.NODE_UNAVAILABLE_TYPES)), "mihomo")
        .when(_chain_has(chain, lambda e: e["type"].isin(vocab.NETWORK_ERROR_TYPES)), "network")
        .when(network_text, "network")
        .otherwise("terminal")
    )
    limited = F.get(F.filter(chain, lambda e: e["http_status"] == vocab.RATE_LIMIT_HTTP_STATUS), F.lit(0))
    staged = attempts.withColumn("category", category).withColumn("_limited", limited["retry_after"])
    return staged.withColumn(
        "retry_after", F.when(F.col("category") == "rate_limit", retry_after_seconds(F.col("_limited"), now))
    ).drop("_limited").withColumn("retryable", F.col("category") != "terminal").withColumn(
        "rotate_node", F.col("category") == "network"
    )


def classify_failures(attempts: DataFrame, now: str) -> DataFrame:
    """Decision for every failed attempt."""
    return with_decision(attempts, now).select(
        "operation", "attempt", "category", "retryable", "rotate_node", "retry_after"
    )


def classify_command_output(outputs: DataFrame) -> DataFrame:
    """Network or terminal failure of a provider command, with its redacted detail text."""
    message = redact(F.col("output"))
    staged = outputs.withColumn("_message", strip(message)).withColumn(
        "_message", F.when(F.col("_message") == "", vocab.NO_DIAGNOSTICS).otherwise(F.col("_message"))
    )
    folded = F.lower("_message")
    category = (
        F.when(F.col("exit_code") == 0, "ok")
        .when(folded.rlike(any_of(vocab.TERMINAL_COMMAND_TEXTS)), "terminal")
        .when(folded.rlike(any_of(vocab.NETWORK_COMMAND_TEXTS)), "network").otherwise("terminal")
    )
    detail = F.concat("command", F.lit(" exited with status "), F.col("exit_code").cast("string"), F.lit(": "), "_message")
    raw = strip("output")
    kept = F.when(raw == "", F.concat(F.lit("exit status "), F.col("exit_code").cast("string"))).otherwise(
        F.right(raw, F.lit(vocab.COMMAND_TEXT_LIMIT))
    )
    return staged.select("run_id", "exit_code", category.alias("category"), detail.alias("detail"), kept.alias("command_text"))


def server_failure_runs(decided: DataFrame, block: int = SEQUENCE_BLOCK) -> DataFrame:
    """Consecutive server failures of an operation up to every attempt, and whether to rotate the node.

    ``decided`` has operation, attempt and category; its other columns stay. The run is counted
    inside blocks of attempts and carried from block to block, so one endless operation is spread
    over many tasks: the only window over a whole operation sees one summary per block (server
    failures, where the last reset is, the run at its end), and only those summaries are shuffled again.
    """
    is_server = (F.col("category") == "server").cast("int")
    blocked = decided.withColumn("_block", F.floor(F.col("attempt") / F.lit(block)).cast("bigint")).withColumn("_server", is_server)
    inside = W.partitionBy("operation", "_block").orderBy("attempt").rowsBetween(W.unboundedPreceding, W.currentRow)
    # Server failures so far less those up to the last reset; they never fall, so the latter is a maximum.
    so_far = F.sum("_server").over(inside)
    at_reset = F.max(F.when(F.col("_server") == 0, F.col("_so_far"))).over(inside)
    counted = blocked.withColumn("_so_far", so_far).withColumn("_at_reset", at_reset)
    per_block = counted.groupBy("operation", "_block").agg(F.max("_so_far").alias("servers"), F.max("_at_reset").alias("at_reset"))
    back = W.partitionBy("operation").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    # Counted over the whole operation: the failures before a block, and those up to the last reset before it.
    before = F.coalesce(F.sum("servers").over(back), F.lit(0))
    summed = per_block.withColumn("_before", before)
    reset = F.max(F.col("_before") + F.col("at_reset")).over(back)
    carry = summed.select("operation", "_block", (F.col("_before") - F.coalesce(reset, F.lit(0))).alias("_carry"))
    run = F.col("_so_far") - F.coalesce("_at_reset", -F.col("_carry"))
    joined = counted.join(carry, ["operation", "_block"]).withColumn("server_run", F.when(F.col("_server") == 0, 0).otherwise(run).cast("bigint"))
    return joined.select(*decided.columns, "server_run").withColumn(
        "rotate", F.when(F.col("category") == "server", F.col("server_run") >= 2).otherwise(F.col("category") == "network")
    )


def backoff(attempt: Column, base: float, cap: float) -> Column:
    """Capped exponential delay after the given failed attempt."""
    first = min(base, cap)
    return F.least(F.lit(cap), F.lit(first) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(62)).cast("double")))


def retry_schedule(
    decided: DataFrame, base: float = vocab.RETRY_BASE_SECONDS, cap: float = vocab.RETRY_CAP_SECONDS
) -> DataFrame:
    """Next action and delay after every attempt: retry, give up at the limit, or fail now."""
    exhausted = (F.col("attempt_limit") > 0) & (F.col("attempt") >= F.col("attempt_limit"))
    action = F.when(~F.col("retryable"), "fail_now").when(exhausted, "give_up").otherwise("retry")
    delay = F.greatest(backoff(F.col("attempt"), base, cap), F.coalesce("retry_after", F.lit(0.0)))
    return decided.withColumn("action", action).withColumn("delay_seconds", F.when(F.col("action") == "retry", delay))


def retry_plan(attempts: DataFrame, now: str) -> DataFrame:
    """Classification, failure runs and schedule of every attempt in one plan."""
    scheduled = retry_schedule(server_failure_runs(with_decision(attempts, now)))
    return scheduled.select(
        "operation", "attempt", "category", "action", "delay_seconds", "server_run",
        F.when(F.col("action") == "retry", F.col("rotate")).otherwise(False).alias("rotate_node"),
    )


def run_outcomes(events: DataFrame) -> DataFrame:
    """Per run log: how it ended, attempts, last failure category and scheduled waiting time.

    ``events`` are parsed log lines with source, line_no, event and fields.
    """
    last = {"download_completed": "completed", "download_failed": "failed", "download_interrupted": "interrupted"}
    ending = F.lit(None).cast("string")
    for event, name in last.items():
        ending = F.when(F.col("event") == event, name).otherwise(ending)
    staged = events.withColumn("ending", ending).withColumn("category", F.col("fields")["category"])
    return staged.groupBy("source").agg(
        F.coalesce(F.max_by("ending", F.when(F.col("ending").isNotNull(), F.col("line_no"))), F.lit("started")).alias("outcome"),
        F.count_if(F.col("event") == "download_attempt_started").alias("attempts"),
        F.count_if(F.col("event") == "download_attempt_failed").alias("failures"),
        F.max_by("category", F.when(F.col("category").isNotNull(), F.col("line_no"))).alias("last_category"),
        F.coalesce(
            F.sum(F.when(F.col("event") == "download_retry_scheduled", F.col("fields")["delay_seconds"].try_cast("double"))), F.lit(0.0)
        ).alias("scheduled_delay"),
    )
