"""Source URL columns: parts, provider, identity, version and provider ids.

Every function takes and returns columns, so the work stays inside one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.functions.values import strip

# One pattern, one group per part: scheme, location, host, port, path. User data ends at the last "@".
URL_PARTS = r"^[\x00-\x20]*(?:([A-Za-z][A-Za-z0-9+.-]*):)?//((?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#]*)(?::([^/?#]*))?[^/?#]*)([^?#]*)"


def parse(url: Column) -> Column:
    """Split a URL into a struct; every other function here reads that struct."""
    def part(group: int) -> Column:
        return F.regexp_extract(url, URL_PARTS, group)

    return F.struct(
        F.lower(part(1)).alias("scheme"), part(2).alias("location"), F.lower(part(3)).alias("host"),
        part(4).alias("port_text"), part(5).alias("raw_path"),
        F.array_remove(F.split(F.regexp_replace(part(5), r";[^/]*$", ""), "/"), "").alias("segments"),
    )


def with_parts(df: DataFrame, url: Column, name: str = "_u") -> DataFrame:
    """Add the parsed URL, evaluated once per row.

    A generator of one row binds the struct: as a plain projection the optimizer would copy the
    extractions into every filter and join condition that reads a part.
    """
    return df.select("*", F.explode(F.array(parse(url))).alias(name))


def port(u: Column) -> Column:
    """Port number, or null where none is written or the text is no port."""
    return F.when(u["port_text"].rlike(r"^[0-9]{1,9}\z"), u["port_text"].try_cast("int"))


def port_is_valid(u: Column) -> Column:
    return (u["port_text"] == "") | F.coalesce(port(u) <= 65535, F.lit(False))


def identity_key(u: Column, depth: int = 1) -> Column:
    """Identity of a remote source: scheme, host, port and its first path segments, as one key.

    Null for a missing or local URL, for one without host or path, and for a broken port.
    Scheme and host ignore case, default ports vanish, the path keeps its case.
    """
    number = port(u)
    default_port = ((u["scheme"] == "http") & (number == 80)) | ((u["scheme"] == "https") & (number == 443))
    usable = ~u["scheme"].isin("", "file") & (u["host"] != "") & port_is_valid(u) & (F.size(u["segments"]) > 0)
    shown_port = F.when(number.isNull() | default_port, F.lit("")).otherwise(number.cast("string"))
    first = F.get(u["segments"], F.lit(0)) if depth == 1 else F.array_join(F.slice(u["segments"], 1, depth), "/")
    return F.when(usable, F.concat_ws("|", u["scheme"], u["host"], shown_port, first))


def _names_osf_node(u: Column) -> Column:
    parts = u["segments"]
    api = (
        (u["host"] == "api.osf.io") & (F.size(parts) >= 3)
        & (F.get(parts, F.lit(0)) == "v2") & (F.get(parts, F.lit(1)) == "nodes")
    )
    site = (u["host"] == "osf.io") & F.get(parts, F.lit(0)).rlike(r"^[A-Za-z0-9]{5}\z")
    return F.coalesce(api, F.lit(False)) | F.coalesce(site, F.lit(False))


def _names_zenodo_record(u: Column) -> Column:
    joined = F.array_join(u["segments"], "/")
    doi = (u["host"] == "doi.org") & joined.rlike(r"^10\.(5281|5072)/(?i:zenodo)\.[0-9]+\z")
    on_site = u["host"].isin("zenodo.org", "sandbox.zenodo.org")
    page = joined.rlike(r"^records?/[0-9]+(/|\z)") | (
        ~joined.rlike(r"^records?/[^/]") & joined.rlike(r"^api/records/[0-9]+(/|\z)")
    )
    return doi | (on_site & page)


def provider(u: Column) -> Column:
    """Provider a source URL belongs to, ``other`` where no rule names one."""
    chosen = F.when(_names_osf_node(u), "osf").when(_names_zenodo_record(u), "zenodo")
    for domain, name in vocab.PROVIDER_DOMAINS.items():
        chosen = chosen.when((u["host"] == domain) | u["host"].endswith("." + domain), name)
    return F.when(u["host"].isNotNull(), chosen.otherwise("other"))


def inferred_version(u: Column, named_provider: Column) -> Column:
    """Version written into an OpenNeuro or PhysioNet URL, else null."""
    where = F.regexp_replace(u["raw_path"], r";[^/]*$", "")
    openneuro = F.regexp_extract(where, r"/versions/([0-9]+(?:\.[0-9]+)*)", 1)
    physionet = F.regexp_extract(where, r"/content/[^/]+/([0-9]+(?:\.[0-9]+)+)(?:/|$)", 1)
    return F.when((named_provider == "openneuro") & (openneuro != ""), openneuro).when(
        (named_provider == "physionet") & (physionet != ""), physionet
    )


def download_version(inferred: Column, requested: Column) -> tuple[Column, Column]:
    """Version to download and the reason there is none: a given version wins, trimmed."""
    trimmed = strip(requested)
    version = F.when(requested.isNull(), inferred).when(trimmed != "", trimmed)
    problem = F.when(trimmed == "", "version is blank").when(version.isNull(), "version is required")
    return version, problem


def osf_node_id(text: Column, u: Column) -> tuple[Column, Column]:
    """Lower-case node id named by an id or project URL, and the reason it is refused."""
    is_url = text.contains("://")
    candidate = F.when(is_url, F.get(u["segments"], F.lit(0))).otherwise(text)
    problem = (
        F.when(is_url & ~u["scheme"].isin("http", "https"), "not an http url")
        .when(is_url & ~u["host"].isin("osf.io", "www.osf.io"), "not a project host")
        .when(candidate.isNull(), "no project id")
        .when(~candidate.rlike(r"^[A-Za-z0-9]+\z"), "project id is not alphanumeric")
    )
    return F.when(problem.isNull(), F.lower(candidate)), problem


def zenodo_record_id(text: Column, u: Column) -> tuple[Column, Column]:
    """Numeric record id named by an id or record URL, and the reason it is refused."""
    is_url = text.contains("://")
    parts = u["segments"]
    followers = F.filter(
        F.transform(parts, lambda part, i: F.when(part.isin("record", "records"), F.get(parts, i + 1))),
        lambda part: part.isNotNull(),
    )
    candidate = F.when(is_url, F.get(followers, F.lit(0))).otherwise(text)
    problem = (
        F.when(is_url & (~u["scheme"].isin("http", "https") | (u["location"] == "")), "not an http url")
        .when(is_url & (F.size(followers) != 1), "no single record id")
        .when(~candidate.rlike(r"^[0-9]+\z"), "record id is not numeric")
    )
    return F.when(problem.isNull(), candidate), problem


def openneuro_repository(text: Column, u: Column) -> tuple[Column, Column, Column]:
    """Dataset id, optional snapshot tag, and the reason the reference is refused."""
    is_url = text.contains("://")
    parts = u["segments"]
    candidate = F.when(is_url, F.get(parts, F.lit(1))).otherwise(text)
    version = F.when(is_url & (F.size(parts) == 4), F.get(parts, F.lit(3)))
    problem = (
        F.when(is_url & (~u["scheme"].isin("http", "https") | (u["location"] == "")), "not an http url")
        .when(is_url & (~F.size(parts).isin(2, 4) | (F.get(parts, F.lit(0)) != "datasets")), "not a dataset path")
        .when(is_url & (F.size(parts) == 4) & (F.get(parts, F.lit(2)) != "versions"), "not a version path")
        .when(~candidate.rlike(r"^ds[0-9]+\z"), "dataset id is malformed")
        .when(~version.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*\z"), "version is malformed")
    )
    accepted = problem.isNull()
    return F.when(accepted, candidate), F.when(accepted, version), problem


def normalized_api_base(base: Column) -> Column:
    """API base for an endpoint, gaining ``/api`` once."""
    bare = F.regexp_replace(base, "/+$", "")
    return F.when(bare.endswith("/api"), bare).otherwise(F.concat(bare, F.lit("/api")))


def mirror_source(mirror: str, dataset_id: Column) -> Column:
    """Git source of a dataset on a mirror: template, full repository URL or base URL."""
    if "{dataset_id}" in mirror:
        return F.replace(F.lit(mirror), F.lit("{dataset_id}"), dataset_id)
    bare = mirror.rstrip("/")
    if bare.endswith(".git"):
        return F.when(dataset_id.isNotNull(), F.lit(mirror))
    return F.concat(F.lit(bare + "/"), dataset_id, F.lit(".git"))
