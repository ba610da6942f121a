"""Work over tables of source URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths, urls
from shelfmark.functions.values import strip


def classified(source_urls: DataFrame) -> DataFrame:
    """Source URLs with the provider each belongs to."""
    return urls.with_parts(source_urls, F.col("url")).withColumn("provider", urls.provider(F.col("_u"))).drop("_u")


def classify_source_urls(source_urls: DataFrame) -> DataFrame:
    """Source URLs per provider."""
    return classified(source_urls).groupBy("provider").agg(F.count("*").alias("urls"), F.min("url").alias("first_url"))


def url_identity(source_urls: DataFrame, depth: int = 1) -> DataFrame:
    """Remote identities with the number of source URLs that share each."""
    keyed = urls.with_parts(source_urls, F.col("url")).select("url", urls.identity_key(F.col("_u"), depth).alias("identity"))
    return keyed.groupBy("identity").agg(F.count("*").alias("urls"), F.min("url").alias("first_url"))


def infer_url_versions(source_urls: DataFrame) -> DataFrame:
    """Version of every download request, or the reason it has none, with its provider."""
    staged = classified(source_urls)
    staged = urls.with_parts(staged, F.col("url")).withColumn("inferred", urls.inferred_version(F.col("_u"), F.col("provider")))
    version, problem = urls.download_version(F.col("inferred"), F.col("requested_version"))
    return staged.select("request_id", "provider", "inferred", version.alias("version"), problem.alias("problem"))


def extract_provider_ids(source_urls: DataFrame) -> DataFrame:
    """Canonical id every provider reads from the text, and why a provider refuses it."""
    staged = urls.with_parts(source_urls.withColumn("_text", strip("url")), F.col("_text"))
    text, u = F.col("_text"), F.col("_u")
    node, node_problem = urls.osf_node_id(text, u)
    record, record_problem = urls.zenodo_record_id(text, u)
    dataset, version, dataset_problem = urls.openneuro_repository(text, u)
    return staged.select(
        "request_id", "url",
        node.alias("osf_id"), node_problem.alias("osf_problem"),
        record.alias("zenodo_id"), record_problem.alias("zenodo_problem"),
        dataset.alias("openneuro_id"), version.alias("openneuro_version"), dataset_problem.alias("openneuro_problem"),
    )


def source_worklist(
    source_urls: DataFrame,
    osf_api: str = "https://api.osf.io/v2",
    osf_storage: str = "osfstorage",
    zenodo_api: str = "https://zenodo.org",
    mirror: str = "https://github.com/OpenNeuroDatasets",
) -> DataFrame:
    """Distinct sources to list, with the listing URL and the number of requests behind each."""
    ids = _ids_with_provider(source_urls)
    chosen = (
        F.when(F.col("provider") == "osf", F.struct(F.col("osf_id").alias("id"), F.lit(None).cast("string").alias("version")))
        .when(F.col("provider") == "zenodo", F.struct(F.col("zenodo_id").alias("id"), F.lit(None).cast("string").alias("version")))
        .when(F.col("provider") == "openneuro", F.struct(F.col("openneuro_id").alias("id"), F.col("openneuro_version").alias("version")))
    )
    work = (
        ids.select("provider", chosen.alias("source")).filter("source.id is not null")
        .groupBy("provider", F.col("source.id").alias("source_key"), F.col("source.version").alias("version"))
        .agg(F.count("*").alias("requests"))
    )
    base = urls.normalized_api_base(F.lit(zenodo_api))
    encoded = F.url_encode("source_key")
    listing = (
        F.when(F.col("provider") == "osf", F.concat(F.lit(osf_api + "/nodes/"), encoded, F.lit(f"/files/{osf_storage}/")))
        .when(F.col("provider") == "zenodo", F.concat(base, F.lit("/records/"), encoded))
        .otherwise(urls.mirror_source(mirror, F.col("source_key")))
    )
    return work.select("provider", "source_key", "version", listing.alias("listing_url"), "requests")


def _ids_with_provider(source_urls: DataFrame) -> DataFrame:
    staged = urls.with_parts(source_urls.withColumn("_text", strip("url")), F.col("_text"))
    text, u = F.col("_text"), F.col("_u")
    dataset, version, _ = urls.openneuro_repository(text, u)
    return staged.select(
        urls.provider(u).alias("provider"), urls.osf_node_id(text, u)[0].alias("osf_id"),
        urls.zenodo_record_id(text, u)[0].alias("zenodo_id"), dataset.alias("openneuro_id"), version.alias("openneuro_version"),
    )


def storage_paths(datasets: DataFrame, root: str = "/registry/datasets") -> DataFrame:
    """Managed folder, incoming workspace and log name of every dataset.

    ``sharing`` counts the datasets behind the same workspace: those would meet in one folder.
    """
    last_version = F.col("version")
    planned = datasets.select(
        "dataset_id",
        paths.destination(root, F.col("dataset_id"), F.col("name"), last_version).alias("destination"),
        paths.workspace(F.col("provider"), F.coalesce("source_url", F.lit("")), last_version).alias("workspace"),
        paths.ingest_log(F.col("name"), last_version).alias("log_name"),
    )
    sharing = planned.groupBy("workspace").agg(F.count("*").alias("sharing"))
    return planned.join(sharing, "workspace").select("dataset_id", "destination", "workspace", "log_name", "sharing")
