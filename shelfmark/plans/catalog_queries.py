"""The registered queries: every catalog operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text, values
from shelfmark.operators import (
    conflicts,
    failures,
    gates,
    health,
    intake,
    inventory,
    manifests,
    ranking,
    search,
    sources,
)
from shelfmark.plans import payloads
from shelfmark.plans.adapters import Catalog
from shelfmark.session import configure, cut_lineage, fresh_dir
from shelfmark.sources import listing_problems as listing_problems_of
from shelfmark.sources import listings, logs, registry
from shelfmark.streaming import jobs

NOW = "2024-01-31 00:00:00"
CALLER_UID = 1001
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
    """Register a query under the name of its function."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(Catalog(configure(spark), folder))

    QUERIES[build.__name__] = run
    return build


def _joined(column: str, separator: str = "|"):
    return F.array_join(column, separator).alias(column)


# -- Scans, sources, sinks --------------------------------------------------------------------

@query
def registry_scan(c: Catalog) -> DataFrame:
    root = fresh_dir(c.spark, "registry")
    tables = {"datasets": c.datasets, "dataset_aliases": c.dataset_aliases, "ingestion_jobs": c.ingestion_jobs, "health_history": c.health_history}
    registry.write_version(tables, root, 1)
    report = None
    for name in tables:
        table = registry.read_table(c.spark, root, name)
        part = table.groupBy(F.lit(name).alias("table_name")).agg(
            F.count("*").alias("rows"), F.count_distinct("dataset_id").alias("datasets")
        )
        report = part if report is None else report.unionByName(part)
    return report


@query
def reconcile_schema(c: Catalog) -> DataFrame:
    old = c.datasets.drop("version", "storage_mode", "size_bytes_known").withColumn("legacy_note", F.concat(F.lit("old "), "dataset_id"))
    current = registry.reconcile_schema(old, "datasets")
    added = c.datasets.withColumn("dataset_id", F.concat("dataset_id", F.lit("-new")))
    return registry.append_to_reconciled(current, added).select(
        "dataset_id", "name", "version", "storage_mode", "size_bytes_known", "legacy_note"
    )


@query
def osf_manifest(c: Catalog) -> DataFrame:
    pages, roots = payloads.osf_pages(c.raw("orders"))
    pages = cut_lineage(pages)  # listings land as a stored table
    return listings.osf_manifest(pages, roots).select("source_id", "relative_path", "size", "download_url")


@query
def zenodo_manifest(c: Catalog) -> DataFrame:
    return listings.zenodo_manifest(payloads.zenodo_records(c.raw("orders")))


@query
def hub_listing(c: Catalog) -> DataFrame:
    return listings.hub_listing(payloads.hub_listings(c.raw("orders")))


def _listings(c: Catalog) -> dict[str, tuple[DataFrame, DataFrame, DataFrame]]:
    """(manifest, problems, verdicts) of faulty listings, by provider."""
    orders = c.raw("orders")
    pages, roots = payloads.broken_osf_pages(orders)
    return {
        "osf": listing_problems_of.read_osf(cut_lineage(pages), roots),
        "zenodo": listing_problems_of.read_zenodo(payloads.broken_zenodo_records(orders)),
        "huggingface": listing_problems_of.read_hub(payloads.broken_hub_listings(orders)),
    }


def _of_all_providers(parts: dict[str, DataFrame]) -> DataFrame:
    named = [rows.withColumn("provider", F.lit(provider)) for provider, rows in parts.items()]
    return reduce(DataFrame.unionByName, named)


@query
def listing_problems(c: Catalog) -> DataFrame:
    return _of_all_providers({provider: problems for provider, (_, problems, _) in _listings(c).items()})


@query
def listing_verdicts(c: Catalog) -> DataFrame:
    return _of_all_providers({provider: verdicts for provider, (_, _, verdicts) in _listings(c).items()})


@query
def listing_outcomes(c: Catalog) -> DataFrame:
    orders = c.raw("orders")
    manifest, _, verdicts = listing_problems_of.read_zenodo(payloads.broken_zenodo_records(orders))
    return listing_problems_of.listing_outcomes(manifest, verdicts, payloads.zenodo_local_files(orders))


@query
def parse_run_logs(c: Catalog) -> DataFrame:
    return logs.parse_run_logs(c.log_lines).select(
        "source", "line_no", "ts_text", "level", "event",
        F.when(F.col("fields").isNotNull(), text.render_fields(F.col("fields"))).alias("fields"),
    )


@query
def manifest_documents(c: Catalog) -> DataFrame:
    path = fresh_dir(c.spark, "documents")
    registry.write_documents(registry.manifest_documents(c.datasets, c.dataset_aliases), path)
    return registry.read_documents(c.spark, path)


def _checks(c: Catalog) -> DataFrame:
    return health.health_check(c.datasets, c.file_inventory, c.annex_inspections, c.repairs)


@query
def problem_log_sink(c: Catalog) -> DataFrame:
    path = fresh_dir(c.spark, "problems")
    registry.append_problems(health.apply_health(c.datasets, _checks(c), "run1", NOW).problems, path)
    return registry.read_problems(c.spark, path)



# -- Derived columns --------------------------------------------------------------------------

@query
def classify_source_urls(c: Catalog) -> DataFrame:
    return sources.classify_source_urls(c.source_urls)


@query
def url_identity(c: Catalog) -> DataFrame:
    return sources.url_identity(c.source_urls)


@query
def infer_url_versions(c: Catalog) -> DataFrame:
    return sources.infer_url_versions(c.source_urls)


@query
def extract_provider_ids(c: Catalog) -> DataFrame:
    return sources.extract_provider_ids(c.source_urls)


@query
def source_worklist(c: Catalog) -> DataFrame:
    return sources.source_worklist(c.source_urls)


@query
def storage_paths(c: Catalog) -> DataFrame:
    return sources.storage_paths(c.datasets)


@query
def redact_text(c: Catalog) -> DataFrame:
    return c.log_texts.select("text_id", text.redact(F.col("text")).alias("redacted"))


@query
def redact_fields(c: Catalog) -> DataFrame:
    parsed = logs.parse_run_logs(c.log_lines).filter("fields is not null")
    return parsed.select(
        "source", "line_no", text.render_fields(text.redact_fields(F.col("fields"))).alias("fields"),
        text.render_fields(text.safe_configuration(F.col("fields"))).alias("configuration"),
    )


@query
def serialize_datasets(c: Catalog) -> DataFrame:
    return search.serialize_datasets(c.datasets, c.dataset_aliases).withColumns(
        {"modalities": F.array_join("modalities", "|")}
    )


@query
def normalize_modalities(c: Catalog) -> DataFrame:
    bad = values.unknown_modalities(F.col("modalities"))
    return c.intake_requests.select(
        "request_id", F.when(F.size(bad) == 0, F.array_join(values.normalized_modalities(F.col("modalities")), ",")).alias("normalized"),
        F.array_join(bad, ",").alias("unknown"),
    )


@query
def normalize_aliases(c: Catalog) -> DataFrame:
    return c.intake_requests.select(
        "request_id", values.has_blank(F.col("aliases")).alias("has_blank"),
        F.array_join(values.normalized_aliases(F.col("aliases"), values.strip("name")), "|").alias("normalized"),
    )


@query
def access_plan(c: Catalog) -> DataFrame:
    return inventory.access_summary(c.file_inventory, CALLER_UID)


# -- Filters ----------------------------------------------------------------------------------

@query
def find_datasets(c: Catalog) -> DataFrame:
    return search.find_datasets(c.datasets, c.dataset_aliases, query="rc1_", modality="eeg").select(
        "dataset_id", "name", "provider", "status", F.unix_timestamp("created_at").alias("created_epoch")
    )


@query
def find_by_url(c: Catalog) -> DataFrame:
    found = search.find_datasets(c.datasets, c.dataset_aliases, url="https://zenodo.org/records/1", show_all=True)
    return found.select("dataset_id", "name", "provider", "status")


@query
def find_of_provider(c: Catalog) -> DataFrame:
    found = search.find_datasets(c.datasets, c.dataset_aliases, provider="openneuro", modality="meg", exact_modality=True, show_all=True)
    return found.select("dataset_id", "name", "status", _joined("modalities", ","))


@query
def eligible_nodes(c: Catalog) -> DataFrame:
    return ranking.eligible_nodes(c.proxies, marker="-cheap")


@query
def validate_manifest(c: Catalog) -> DataFrame:
    return manifests.judged_manifest(c.manifest_files).withColumn("errors", F.array_join("errors", ", "))


@query
def validate_intake_requests(c: Catalog) -> DataFrame:
    local = intake.validate_intake_requests(c.intake_requests)
    remote = intake.validate_intake_requests(c.intake_requests, download=True).select(
        "request_id", F.array_join("errors", ", ").alias("download_errors"), F.col("version").alias("download_version")
    )
    return local.select(
        "request_id", "name", "provider", "version", _joined("modalities", ","), _joined("aliases"), "source_reference",
        "has_remote_url", _joined("errors", ", "),
    ).join(remote, "request_id")


@query
def allowed_sources(c: Catalog) -> DataFrame:
    return intake.allowed_sources(c.source_paths, "/registry", "/registry/incoming", ["/shared/raw", "/lab"])


# -- Joins ------------------------------------------------------------------------------------

@query
def search_by_name(c: Catalog) -> DataFrame:
    return search.search_by_name(c.needles, c.datasets, c.dataset_aliases)


@query
def resolve_identifiers(c: Catalog) -> DataFrame:
    return search.resolve_identifiers(c.identifier_requests, c.datasets, c.dataset_aliases)


@query
def match_urls(c: Catalog) -> DataFrame:
    return search.match_urls(c.source_urls, c.datasets, c.dataset_aliases)


@query
def ambiguous_urls(c: Catalog) -> DataFrame:
    return search.ambiguous_urls(c.source_urls, c.datasets, c.dataset_aliases)


def _identity_requests(c: Catalog) -> DataFrame:
    checked = intake.validate_intake_requests(c.intake_requests)
    return checked.select("request_id", "name", "source_reference", "aliases")


@query
def identity_conflicts(c: Catalog) -> DataFrame:
    return conflicts.identity_conflicts(_identity_requests(c), c.datasets, c.dataset_aliases)


@query
def alias_conflicts(c: Catalog) -> DataFrame:
    asked = c.alias_requests.select(
        "request_id", F.replace("request_id", F.lit("a-"), F.lit("ds-")).alias("dataset_id"),
        F.filter(values.normalized_aliases(F.col("aliases")), lambda a: a != "").alias("aliases"),
    )
    return conflicts.alias_conflicts(asked, c.datasets, c.dataset_aliases)


@query
def source_reference_conflicts(c: Catalog) -> DataFrame:
    asked = c.update_requests.select(
        "request_id", F.replace("request_id", F.lit("u-"), F.lit("ds-")).alias("dataset_id"), F.col("url").alias("source_reference")
    ).filter("source_reference is not null")
    return conflicts.source_reference_conflicts(asked, c.datasets, c.dataset_aliases)


@query
def pending_files(c: Catalog) -> DataFrame:
    return manifests.pending_files(manifests.accepted_manifest(c.manifest_files), c.local_files)


@query
def constraint_violations(c: Catalog) -> DataFrame:
    return conflicts.constraint_violations(c.datasets, c.dataset_aliases, c.ingestion_jobs, c.health_history)


@query
def transfer_plan(c: Catalog) -> DataFrame:
    return manifests.transfer_plan(manifests.accepted_manifest(c.manifest_files), c.local_files)


@query
def missing_content(c: Catalog) -> DataFrame:
    return inventory.missing_content(c.file_inventory)


@query
def discover_selector(c: Catalog) -> DataFrame:
    return ranking.discover_selector(c.connections, c.proxies, "speed.example.net")


@query
def health_problems(c: Catalog) -> DataFrame:
    return health.health_problems(c.datasets, c.health_history)


@query
def workspace_plan(c: Catalog) -> DataFrame:
    return manifests.workspace_plan(c.download_requests, c.workspaces)


# -- Aggregations -----------------------------------------------------------------------------

@query
def dataset_sizes(c: Catalog) -> DataFrame:
    return inventory.dataset_sizes(c.file_inventory)


@query
def payload_markers(c: Catalog) -> DataFrame:
    return inventory.payload_markers(c.file_inventory)


@query
def transfer_summary(c: Catalog) -> DataFrame:
    return manifests.transfer_summary(manifests.accepted_manifest(c.manifest_files), c.local_files)


@query
def duplicate_paths(c: Catalog) -> DataFrame:
    return manifests.duplicate_paths(c.manifest_files)


@query
def latency_profiles(c: Catalog) -> DataFrame:
    return ranking.latency_profiles(c.node_probes_open).withColumns(
        {"success_ratio": F.round("success_ratio", 6), "median_latency": F.round("median_latency", 6)}
    )


@query
def node_scores(c: Catalog) -> DataFrame:
    return ranking.node_scores(c.node_probes_open).withColumns(
        {"overall_ratio": F.round("overall_ratio", 6), "median_throughput": F.round("median_throughput", 6)}
    )


@query
def alias_rollup(c: Catalog) -> DataFrame:
    return search.alias_rollup(c.dataset_aliases)


@query
def missing_content_summary(c: Catalog) -> DataFrame:
    return inventory.missing_content_summary(c.file_inventory)


@query
def verify_complete(c: Catalog) -> DataFrame:
    return manifests.verify_complete(manifests.accepted_manifest(c.manifest_files), c.local_files)


@query
def probe_throughput(c: Catalog) -> DataFrame:
    return ranking.probe_throughput(c.stream_chunks)


@query
def run_outcomes(c: Catalog) -> DataFrame:
    events = logs.parse_run_logs(c.log_lines.filter(F.col("source").startswith("run-")))
    return failures.run_outcomes(events).withColumn("scheduled_delay", F.round("scheduled_delay", 3))


# -- Windows ----------------------------------------------------------------------------------

@query
def latest_health(c: Catalog) -> DataFrame:
    return health.latest_health(c.health_history).select("dataset_id", "check_id", "result", "resulting_status", "message")


@query
def server_failure_runs(c: Catalog) -> DataFrame:
    return failures.server_failure_runs(failures.with_decision(c.attempts, NOW).select("operation", "attempt", "category"))


@query
def retry_schedule(c: Catalog) -> DataFrame:
    return failures.retry_schedule(failures.with_decision(c.attempts, NOW)).select("operation", "attempt", "action", "delay_seconds")


@query
def rank_nodes(c: Catalog) -> DataFrame:
    return ranking.rank_nodes(ranking.latency_profiles(c.node_probes_open), ranking.node_scores(c.node_probes_open))


@query
def benchmark_groups(c: Catalog) -> DataFrame:
    resting = ranking.node_cooldowns(c.group_failures, NOW, cooldown=24 * 60 * 60)
    ranked = ranking.benchmark_groups(c.proxies, "-cheap", resting, c.group_probes, c.sample_chunks)
    return ranked.withColumns({name: F.round(name, 6) for name in ("overall_ratio", "median_throughput", "p95_latency")})


@query
def cooldown_gate(c: Catalog) -> DataFrame:
    return gates.cooldown_gate(c.environment_runs).select("environment", F.unix_micros("ts").alias("kept_us"))


@query
def node_cooldowns(c: Catalog) -> DataFrame:
    return ranking.node_cooldowns(c.node_failures, NOW).withColumn("rests_until", F.round("rests_until", 3))


@query
def failover_choice(c: Catalog) -> DataFrame:
    order = cut_lineage(
        ranking.rank_nodes(ranking.latency_profiles(c.node_probes_open), ranking.node_scores(c.node_probes_open), size=10)
    )
    samples = c.node_probes_open.filter("phase = 'throughput'").select("node", "ok")
    resting = ranking.node_cooldowns(c.node_failures, "2024-01-30 12:00:00")
    chosen = ranking.failover_choice(order, resting, samples, failed="node-3")
    step = ranking.next_node(order, resting, "node-1", "2024-01-30 08:00:00", "2024-01-30 12:00:00", marker="node")
    return chosen.select(
        F.lit("failover").alias("decision"), F.when(F.col("node").isNull(), "none").otherwise("switch").alias("action"), "node"
    ).unionByName(step.select(F.lit("next attempt").alias("decision"), "action", "node"))


@query
def conflict_owner(c: Catalog) -> DataFrame:
    return conflicts.newest_owners(c.datasets, c.dataset_aliases).select("key", F.col("owner.dataset_id").alias("owner_id"))


# -- Sets -------------------------------------------------------------------------------------

def _updates(c: Catalog) -> DataFrame:
    def listed(column: str):
        return F.filter(F.col(column), lambda v: v != "")

    return c.update_requests.withColumn("modalities", listed("modality_names")).withColumn("aliases", listed("alias_names")).drop(
        "modality_names", "alias_names"
    )


@query
def merge_modalities(c: Catalog) -> DataFrame:
    asked = _updates(c).select(F.replace("request_id", F.lit("u-"), F.lit("ds-")).alias("dataset_id"), F.col("modalities").alias("added"))
    return c.datasets.join(asked, "dataset_id").select(
        "dataset_id", F.array_join(values.merged_modalities(F.col("modalities"), F.col("added")), ",").alias("modalities")
    )


@query
def supplement_shortlist(c: Catalog) -> DataFrame:
    cheap = ranking.latency_profiles(c.node_probes)
    real = ranking.latency_profiles(c.node_probes, phases=("real_latency",))
    return ranking.supplement_shortlist(cheap, real).select("node", "node_order", "successes", "attempts", "origin")


# -- Registry writes --------------------------------------------------------------------------

@query
def register_batch(c: Catalog) -> DataFrame:
    outcomes = intake.register_batch(c.intake_requests, c.datasets, c.dataset_aliases).outcomes
    return outcomes


def _plain_datasets(df: DataFrame) -> DataFrame:
    """Dataset rows with the list as text and the time as a number, which compare alike everywhere."""
    return df.withColumns({"modalities": F.array_join("modalities", ","), "created_at": F.unix_timestamp("created_at")})


@query
def registered_datasets(c: Catalog) -> DataFrame:
    return _plain_datasets(intake.register_batch(c.intake_requests, c.datasets, c.dataset_aliases).datasets)


@query
def registered_aliases(c: Catalog) -> DataFrame:
    return intake.register_batch(c.intake_requests, c.datasets, c.dataset_aliases).aliases


@query
def registered_jobs(c: Catalog) -> DataFrame:
    jobs_ = intake.register_batch(c.intake_requests, c.datasets, c.dataset_aliases).jobs
    return jobs_.withColumn("created_at", F.unix_timestamp("created_at"))


@query
def moved_datasets(c: Catalog) -> DataFrame:
    change = intake.storage_transitions(c.transition_requests, c.datasets, inventory.dataset_sizes(c.file_inventory))
    return _plain_datasets(change.datasets)


@query
def transition_jobs(c: Catalog) -> DataFrame:
    return intake.storage_transitions(c.transition_requests, c.datasets, inventory.dataset_sizes(c.file_inventory)).jobs


@query
def add_aliases(c: Catalog) -> DataFrame:
    return intake.add_aliases(c.alias_requests, c.datasets, c.dataset_aliases).outcomes


@query
def update_metadata(c: Catalog) -> DataFrame:
    return intake.update_metadata(_updates(c), c.datasets, c.dataset_aliases).outcomes


@query
def storage_transitions(c: Catalog) -> DataFrame:
    return intake.storage_transitions(c.transition_requests, c.datasets, inventory.dataset_sizes(c.file_inventory)).outcomes


@query
def apply_health(c: Catalog) -> DataFrame:
    return health.apply_health(c.datasets, _checks(c), "run1", NOW).datasets.select(
        "dataset_id", "status", "size_bytes", "size_bytes_known", "storage_path"
    )


@query
def health_history(c: Catalog) -> DataFrame:
    rows = health.apply_health(c.datasets, _checks(c), "run1", NOW).history
    return rows.withColumns({name: F.unix_timestamp(name) for name in ("started_at", "completed_at")})


@query
def ingest_audit(c: Catalog) -> DataFrame:
    return intake.ingest_audit(c.ingestion_jobs).withColumns(
        {"first_at": F.unix_timestamp("first_at"), "last_at": F.unix_timestamp("last_at")}
    )


@query
def access_report(c: Catalog) -> DataFrame:
    return inventory.access_report(c.file_inventory, CALLER_UID)


# -- Health -----------------------------------------------------------------------------------

@query
def health_check(c: Catalog) -> DataFrame:
    return health.health_check(c.datasets, c.file_inventory, c.annex_inspections).drop("name", "storage_path")


@query
def repair_outcomes(c: Catalog) -> DataFrame:
    return health.repair_outcomes(c.datasets, c.file_inventory, c.annex_inspections, c.repairs).drop("name", "storage_path")


@query
def inventory_changes(c: Catalog) -> DataFrame:
    return inventory.inventory_changes(c.file_inventory, c.file_inventory_after)


@query
def repair_evidence(c: Catalog) -> DataFrame:
    evidence = inventory.repair_evidence(c.file_inventory, c.file_inventory_after, c.repairs)
    return health.health_check(c.datasets, c.file_inventory, c.annex_inspections, evidence, c.storage_roots).drop("name", "storage_path")


@query
def quick_check_roots(c: Catalog) -> DataFrame:
    running = c.repairs.filter("exit_code <> 0").select("dataset_id")
    return health.quick_check_flags(c.datasets, c.file_inventory, running, c.storage_roots).select("dataset_id", "result", "status", "warning")


@query
def quick_check_flags(c: Catalog) -> DataFrame:
    return health.quick_check_flags(c.datasets, c.file_inventory, c.repairs.filter("exit_code <> 0").select("dataset_id"))


# -- Failures ---------------------------------------------------------------------------------

@query
def classify_failures(c: Catalog) -> DataFrame:
    return failures.classify_failures(c.attempts, NOW)


@query
def classify_command_output(c: Catalog) -> DataFrame:
    return failures.classify_command_output(c.command_outputs)


@query
def retry_plan(c: Catalog) -> DataFrame:
    return failures.retry_plan(c.attempts, NOW)


# -- Streams ----------------------------------------------------------------------------------

def _in_pieces(df: DataFrame, order: str, pieces: int, label: str, files: int | None = None) -> str:
    """Write a table as consecutive slices of its order column, the way an append-only log grows.

    With ``files`` each slice is so many files.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    bounds = df.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    step = (bounds["high"] - bounds["low"]) / pieces
    for i in range(pieces):
        piece = df.filter(F.col(order) >= F.lit(bounds["low"] + step * i))
        if i < pieces - 1:
            piece = piece.filter(F.col(order) < F.lit(bounds["low"] + step * (i + 1)))
        (piece if files is None else piece.repartition(files)).write.mode("append").parquet(path)
    return path


def _stream(df: DataFrame, order: str, label: str, pieces: int = 3, files: int = 1000) -> DataFrame:
    path = _in_pieces(df, order, pieces, label)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


@query
def stream_redacted_logs(c: Catalog) -> DataFrame:
    target = fresh_dir(c.spark, "stream-logs")
    lines = _stream(c.log_lines, "line_no", "log-lines", files=8)
    jobs.stream_redacted_logs(lines, target)
    return c.spark.read.schema(logs.redacted_events(c.log_lines).schema).parquet(f"{target}/out")


@query
def stream_problem_alerts(c: Catalog) -> DataFrame:
    target = fresh_dir(c.spark, "stream-alerts")
    jobs.stream_problem_alerts(_stream(c.health_history, "started_at", "history"), target)
    return c.spark.read.schema("check_id string, dataset_id string, message string, result string").json(f"{target}/out")


def _arriving(df: DataFrame, order: str, pieces: int, label: str, files: int = 4) -> DataFrame:
    """A stream that takes one slice of a table, in several files, per batch."""
    path = _in_pieces(df, order, pieces, label, files)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


@query
def stream_cooldown_gate(c: Catalog) -> DataFrame:
    target = fresh_dir(c.spark, "stream-gate")
    jobs.stream_cooldown_gate(_arriving(c.environment_runs, "ts", 3, "runs"), target)
    return c.spark.read.schema("environment string, ts timestamp").parquet(f"{target}/out").select(
        "environment", F.unix_micros("ts").alias("kept_us")
    )


@query
def stream_intake_gate(c: Catalog) -> DataFrame:
    target = fresh_dir(c.spark, "stream-intake")
    jobs.seed_intake_registry(c.datasets, c.dataset_aliases, target)
    jobs.stream_intake_gate(_arriving(c.intake_requests, "requested_at", 2, "requests"), target)
    return c.spark.read.schema(
        "request_id string, outcome string, reason string, owner_id string, dataset_id string, batch_id bigint"
    ).parquet(f"{target}/outcomes").drop("batch_id")


@query
def stream_latest_status(c: Catalog) -> DataFrame:
    target = fresh_dir(c.spark, "stream-status")
    jobs.stream_latest_status(_stream(c.health_history, "started_at", "history", files=4), target)
    return jobs.read_latest_status(c.spark, target)
