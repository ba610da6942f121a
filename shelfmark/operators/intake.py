"""Batch writes to the registry: intake, aliases, metadata, storage transitions.

Tables are immutable files, so every job computes the next rows from the current tables and
returns them beside an outcome report; ``sources.registry`` writes them as the next version.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.functions import paths, urls, values
from shelfmark.functions.tables import first_per_key, reason_list
from shelfmark.operators.conflicts import (
    alias_conflicts,
    decide_conflicts,
    identity_probes,
    newest_owners,
    settle_claims,
    source_reference_conflicts,
)
from shelfmark.operators.search import resolve_identifiers
from shelfmark.session import counted_cut, cut_lineage


class RegistryChange(NamedTuple):
    """Rows to add or replace and one outcome row per request."""

    datasets: DataFrame
    aliases: DataFrame
    jobs: DataFrame | None
    outcomes: DataFrame


def validate_intake_requests(requests: DataFrame, download: bool = False) -> DataFrame:
    """Normalize intake requests and list what is wrong with each.

    The URL decides the provider and may hold the version; the source reference is the URL or
    the ``file://`` form of the source path. Download requests also need a known provider, a
    modality and a version.
    """
    staged = urls.with_parts(requests, F.col("url")).withColumn("_from_url", urls.provider(F.col("_u"))).withColumn(
        "_inferred", urls.inferred_version(F.col("_u"), F.col("_from_url"))
    )
    has_url = F.coalesce(F.col("url") != "", F.lit(False))
    named = values.strip("name")
    if download:
        version, version_problem = urls.download_version(F.col("_inferred"), F.col("version"))
    else:
        # An empty version counts as none; only a missing one is read from the URL.
        version = F.coalesce(
            F.nullif(F.when(F.col("version").isNull() & has_url, F.col("_inferred")).otherwise(F.col("version")), F.lit("")),
            F.lit("unknown"),
        )
        version_problem = F.lit(None).cast("string")
    unknown = values.unknown_modalities(F.col("modalities"))
    checks = [
        (named == "", "name is blank"),
        (values.has_blank(F.col("aliases")), "alias is blank"),
        (F.size(unknown) > 0, "unknown modality"),
        (version_problem.isNotNull(), "no version"),
    ]
    if download:
        checks += [
            (F.coalesce(F.col("_from_url"), F.lit("other")) == "other", "unknown provider"),
            (F.size("modalities") == 0, "no modality"),
        ]
    return staged.select(
        *[c for c in requests.columns if c not in ("name", "provider", "version", "modalities", "aliases")],
        named.alias("name"),
        F.when(has_url, F.col("_from_url")).otherwise(F.col("provider")).alias("provider"),
        version.alias("version"),
        values.normalized_modalities(F.col("modalities")).alias("modalities"),
        values.normalized_aliases(F.col("aliases"), named).alias("aliases"),
        F.when(has_url, F.col("url")).otherwise(F.concat(F.lit("file://"), "source")).alias("source_reference"),
        F.col("url").isNotNull().alias("has_remote_url"),
        reason_list(*checks).alias("errors"),
    )


def allowed_sources(
    requests: DataFrame, managed_root: str, incoming_root: str, roots: list[str]
) -> DataFrame:
    """Decide which source paths protected intake accepts. The roots are configuration, so they are literals."""
    source = F.rtrim(F.col("source"), F.lit("/"))
    below_any = F.lit(False)
    for root in roots:
        below_any = below_any | paths.is_below(source, root)
    verdict = (
        F.when(~F.col("is_dir"), "not a directory")
        .when(paths.is_below(source, incoming_root), "ok")
        .when(paths.is_below(source, managed_root), "inside managed storage")
        .when(below_any, "ok")
        .otherwise("outside allowed roots")
    )
    return requests.select("request_id", "source", (verdict == "ok").alias("accepted"), verdict.alias("verdict"))


def _dataset_id(name: Column, source: Column, version: Column) -> Column:
    return F.concat(F.lit("ds-"), F.left(F.sha2(F.concat_ws("\x1f", name, source, version), 256), F.lit(32)))


def _claims(requests: DataFrame) -> DataFrame:
    """Keys an accepted request holds: names without case, and every stored spelling."""
    stored = F.concat(F.array("name", "source_reference"), F.col("aliases"))
    names = F.concat(F.array("name"), F.col("aliases"))
    keys = F.array_distinct(F.concat(
        F.transform(names, lambda v: F.concat(F.lit("name|"), F.lower(v))),
        F.transform(stored, lambda v: F.concat(F.lit("value|"), v)),
    ))
    return requests.select("request_id", "ord", F.col("request_id").alias("holder"), F.explode(keys).alias("key"))


def _held_in_batch(accepted: DataFrame, dataset_id: Column) -> DataFrame:
    """Keys of accepted requests, spelled like the keys of registered datasets."""
    keys = F.array_distinct(F.concat(
        F.array(
            F.concat(F.lit("id|"), dataset_id), F.concat(F.lit("name|"), F.lower("name")),
            F.concat(F.lit("ref|"), "source_reference"),
        ),
        F.transform("aliases", lambda v: F.concat(F.lit("name|"), F.lower(v))),
    ))
    return accepted.select(
        F.explode(keys).alias("key"), F.col("ord").alias("held_ord"),
        F.struct(F.col("requested_at").alias("created_at"), dataset_id.alias("dataset_id")).alias("owner"),
    )


def register_batch(
    requests: DataFrame,
    datasets: DataFrame,
    aliases: DataFrame,
    managed_root: str = "/registry/datasets",
    download: bool = False,
) -> RegistryChange:
    """Register a batch of intake requests as if each came alone, in order of request time.

    ``download`` requests follow the stricter rules of downloads and always move their workspace.

    Invalid requests and those that clash with the registry or with an earlier accepted request
    leave no row. A source that is no directory and a negative size fail after the clash checks.
    """
    def held(keys: DataFrame) -> DataFrame:
        # Stored alias values are unique whatever their kind, so a name may not repeat a stored URL or path either.
        stored = aliases.select(F.concat(F.lit("value|"), "value").alias("key")).distinct()
        owners = newest_owners(datasets, aliases)
        return owners.unionByName(stored.withColumn("owner", F.lit(None).cast(owners.schema["owner"].dataType)))

    return register_against(requests, held, managed_root, download)


def register_against(
    requests: DataFrame,
    held: Callable[[DataFrame], DataFrame],
    managed_root: str = "/registry/datasets",
    download: bool = False,
) -> RegistryChange:
    """Like ``register_batch``, with the registry known only by a lookup.

    ``held`` takes keys (column key) and returns at least those of them that the registry holds,
    with their newest ``owner``: identities, and stored alias values below ``value|``.
    """
    failure = F.when(~F.col("source_is_dir"), "source is not a directory").when(F.col("size_bytes") < 0, "size is negative")
    staged = cut_lineage(
        validate_intake_requests(requests, download)
        .withColumn("storage_mode", F.lit("move") if download else F.col("storage_mode"))
        .withColumn("ord", F.struct("requested_at", "request_id")).withColumn("failure", failure)
    )
    valid = staged.filter(F.size("errors") == 0)
    probes = identity_probes(valid, "ord")
    values_claimed = _claims(valid).filter(F.col("key").startswith("value|"))
    asked = cut_lineage(probes.select("key").unionByName(values_claimed.select("key")).distinct())
    known = cut_lineage(asked.join(held(asked), "key"))
    identities, stored = known.filter(~F.col("key").startswith("value|")), known.filter(F.col("key").startswith("value|"))
    registered = cut_lineage(probes.join(identities, "key").select("request_id", "role", "pos", "alias", "owner"))
    free = valid.filter("failure is null").join(registered.select("request_id").distinct(), "request_id", "left_anti")
    repeats = values_claimed.join(stored, "key", "left_semi").select("request_id").distinct()
    able = cut_lineage(free.join(repeats, "request_id", "left_anti"))
    lost = settle_claims(_claims(able)).filter(~F.col("accepted")).select("request_id")
    accepted = cut_lineage(able.join(lost, "request_id", "left_anti"))

    dataset_id = _dataset_id(F.col("name"), F.col("source_reference"), F.col("version"))
    in_batch = probes.join(_held_in_batch(accepted, dataset_id), "key").filter(F.col("held_ord") < F.col("ord")).select(
        "request_id", "role", "pos", "alias", "owner"
    )
    verdicts = decide_conflicts(registered.unionByName(in_batch)).select("request_id", F.col("reason").alias("clash"), "owner_id")
    stored_path = F.when(F.col("storage_mode") == "reference", F.col("source")).otherwise(
        paths.destination(managed_root, dataset_id, F.col("name"), F.col("version"))
    )
    new_datasets = accepted.select(
        dataset_id.alias("dataset_id"), "name", "provider", F.col("source_reference").alias("source_url"), "version",
        "modalities", F.coalesce("size_bytes", F.lit(0)).cast("bigint").alias("size_bytes"),
        F.col("size_bytes").isNotNull().alias("size_bytes_known"), F.lit("available").alias("status"),
        stored_path.alias("storage_path"), "storage_mode", F.col("requested_at").alias("created_at"),
    )
    rows = F.concat(
        F.array(
            F.struct(F.when(F.col("has_remote_url"), "url").otherwise("path").alias("kind"), F.col("source_reference").alias("value")),
            F.struct(F.lit("name").alias("kind"), F.col("name").alias("value")),
        ),
        F.transform("aliases", lambda v: F.struct(F.lit("name_alias").alias("kind"), v.alias("value"))),
    )
    new_aliases = accepted.select(dataset_id.alias("dataset_id"), F.explode(rows).alias("a")).select("dataset_id", "a.kind", "a.value")
    new_jobs = accepted.select(
        F.concat(F.lit("job-"), "request_id").alias("job_id"), dataset_id.alias("dataset_id"),
        F.lit("succeeded").alias("status"), F.lit("local").alias("mode"), F.lit(None).cast("string").alias("message"),
        F.col("requested_at").alias("created_at"),
    )
    won = accepted.select("request_id", F.lit(True).alias("won"))
    outcome = (
        F.when(F.size("errors") > 0, "invalid").when(F.col("won"), "accepted").when(F.col("clash").isNotNull(), "conflict")
        .when(F.col("failure").isNotNull(), "failed").otherwise("conflict")
    )
    outcomes = (
        staged.join(verdicts, "request_id", "left").join(won, "request_id", "left").withColumn("outcome", outcome)
        .select(
            "request_id", "outcome",
            F.when(F.col("outcome") == "invalid", F.array_join("errors", ", "))
            .when(F.col("outcome") == "conflict", F.coalesce("clash", F.lit("stored value repeats")))
            .when(F.col("outcome") == "failed", F.col("failure")).alias("reason"),
            F.when(F.col("outcome") == "conflict", F.col("owner_id")).alias("owner_id"),
            F.when(F.col("outcome") == "accepted", dataset_id).alias("dataset_id"),
        )
    )
    return RegistryChange(new_datasets, new_aliases, new_jobs, outcomes)


def _resolved(requests: DataFrame, datasets: DataFrame, aliases: DataFrame) -> DataFrame:
    """Requests with the dataset their identifier names, its name and the resolve outcome."""
    empty = F.lit(None).cast("string")
    asked = requests.select("request_id", "identifier").withColumn("name", empty).withColumn("url", empty)
    found = resolve_identifiers(asked, datasets, aliases).withColumnRenamed("outcome", "resolve_outcome")
    return requests.join(found, "request_id", "left")


def _existing_aliases(aliases: DataFrame) -> DataFrame:
    return aliases.filter(F.col("kind") == "name_alias").select("dataset_id", F.lower("value").alias("folded")).distinct()


def _alias_claims(wanted: DataFrame) -> DataFrame:
    """Claims of alias rows (request_id, dataset_id, alias); requests of one dataset are no rivals."""
    keys = F.array(F.concat(F.lit("name|"), F.lower("alias")), F.concat(F.lit("value|"), "alias"))
    return wanted.select(
        "request_id", F.col("request_id").alias("ord"), F.col("dataset_id").alias("holder"), F.explode(keys).alias("key")
    )


def _new_alias_rows(wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """Alias rows to append: those the dataset does not answer to yet, each once."""
    folded = wanted.withColumn("folded", F.lower("alias")).join(
        _existing_aliases(aliases), ["dataset_id", "folded"], "left_anti"
    )
    once = first_per_key(folded, ["dataset_id", "folded"], [F.col("request_id"), F.col("pos")])
    return once.select("dataset_id", F.lit("name_alias").alias("kind"), F.col("alias").alias("value"))


def add_aliases(requests: DataFrame, datasets: DataFrame, aliases: DataFrame) -> RegistryChange:
    """Append name aliases to datasets; one bad alias rejects its whole request."""
    names = datasets.select("dataset_id", F.col("name").alias("canonical"))
    staged = cut_lineage(
        _resolved(requests, datasets, aliases).join(names, "dataset_id", "left").select(
            "request_id", "dataset_id", "resolve_outcome",
            values.has_blank(F.col("aliases")).alias("blank"),
            values.normalized_aliases(F.col("aliases"), F.col("canonical")).alias("aliases"),
            (F.size("aliases") == 0).alias("none"),
        )
    )
    usable = staged.filter((F.col("resolve_outcome") == "found") & ~F.col("blank") & ~F.col("none"))
    refused = alias_conflicts(usable, datasets, aliases)
    first_refused = refused.groupBy("request_id").agg(F.min(F.struct("pos", "alias", "owner_id")).alias("hit"))
    free = usable.join(first_refused.select("request_id"), "request_id", "left_anti")
    wanted = cut_lineage(free.select("request_id", "dataset_id", F.posexplode("aliases").alias("pos", "alias")))
    lost = settle_claims(_alias_claims(wanted)).filter(~F.col("accepted")).select("request_id", F.lit(True).alias("lost"))
    granted = wanted.join(lost.select("request_id"), "request_id", "left_anti")
    outcome = (
        F.when(F.col("blank") | F.col("none"), "invalid").when(F.col("resolve_outcome") != "found", F.col("resolve_outcome"))
        .when(F.col("hit").isNotNull() | F.col("lost"), "conflict").otherwise("accepted")
    )
    outcomes = staged.join(first_refused, "request_id", "left").join(lost, "request_id", "left").select(
        "request_id", "dataset_id", outcome.alias("outcome"), F.col("hit.alias").alias("alias"), F.col("hit.owner_id").alias("owner_id")
    )
    return RegistryChange(datasets.limit(0), _new_alias_rows(granted, aliases), None, outcomes)


def update_metadata(requests: DataFrame, datasets: DataFrame, aliases: DataFrame) -> RegistryChange:
    """Enrich registered metadata; a request that breaks one rule changes nothing.

    A remote URL is never replaced and decides the provider. Provider and version are filled when
    missing and replaced only with ``force``. Modalities and aliases only grow. Every sound
    request is applied, those of one dataset in the order of their ids. Requests that only add
    modalities or aliases commute, so all of a dataset up to its first other request are applied in
    one round; other requests go one a round, each against what the rounds before left. Rounds run
    over the shrinking rest and lay their changes over the registry, which is read but never written.
    """
    columns = datasets.columns
    now_datasets, now_aliases = datasets, aliases
    changed = new_aliases = outcomes = None
    while True:
        turn = _update_turn(requests, now_datasets, now_aliases)
        told = cut_lineage(turn.outcomes)
        rows, more = cut_lineage(turn.datasets), cut_lineage(turn.aliases)
        # What has changed so far, small beside the registry.
        changed = rows if changed is None else cut_lineage(changed.join(rows, "dataset_id", "left_anti").unionByName(rows))
        new_aliases = more if new_aliases is None else new_aliases.unionByName(more)
        settled = told.filter("outcome <> 'deferred'")
        outcomes = settled if outcomes is None else outcomes.unionByName(settled)
        requests, waiting = counted_cut(requests.join(told.filter("outcome = 'deferred'").select("request_id"), "request_id", "left_semi"))
        if not waiting:
            return RegistryChange(changed, new_aliases, None, outcomes)
        now_datasets = datasets.join(changed.select("dataset_id"), "dataset_id", "left_anti").unionByName(changed.select(*columns))
        now_aliases = aliases.select(*new_aliases.columns).unionByName(new_aliases)


def _update_turn(requests: DataFrame, datasets: DataFrame, aliases: DataFrame) -> RegistryChange:
    """One round of updates; sound requests of a dataset that have to wait for others of it are ``deferred``."""
    current = datasets.select(
        "dataset_id", F.col("name").alias("canonical"), F.col("provider").alias("old_provider"),
        F.col("source_url").alias("old_url"), F.col("version").alias("old_version"), F.col("modalities").alias("old_modalities"),
    )
    asked = urls.with_parts(requests.withColumn("new_url", values.strip("url")), F.col("new_url")).withColumn(
        "_from_url", urls.provider(F.col("_u"))
    ).withColumn("new_version", values.strip("version"))
    joined = _resolved(asked, datasets, aliases).join(current, "dataset_id", "left")
    old = urls.with_parts(joined, F.col("old_url"), "_old")
    has_remote = F.coalesce(~F.col("_old.scheme").isin("", "file"), F.lit(False))
    effective = F.coalesce("_from_url", "provider")
    blank_url, blank_version = F.col("new_url") == "", F.col("new_version") == ""
    nothing = (
        F.col("url").isNull() & F.col("provider").isNull() & F.col("version").isNull()
        & (F.size("modalities") == 0) & (F.size("aliases") == 0)
    )
    changes_url = F.col("new_url").isNotNull() & ~F.col("new_url").eqNullSafe(F.col("old_url"))
    force = F.coalesce(F.col("force"), F.lit(False))
    errors = reason_list(
        (nothing, "nothing to update"),
        (values.has_blank(F.col("aliases")), "alias is blank"),
        (F.size(values.unknown_modalities(F.col("modalities"))) > 0, "unknown modality"),
        (F.col("provider").isNotNull() & ~F.col("provider").isin(vocab.PROVIDERS), "unknown provider"),
        (blank_url, "url is blank"),
        (blank_version, "version is blank"),
        (F.col("provider").isNotNull() & ~blank_url & (F.col("provider") != F.col("_from_url")), "provider conflicts with url"),
        (changes_url & has_remote, "url cannot be replaced"),
        (effective.isNotNull() & (effective != F.col("old_provider")) & (F.col("old_provider") != "other") & ~force, "provider is set"),
        (F.col("new_version").isNotNull() & (F.col("new_version") != F.col("old_version")) & (F.col("old_version") != "unknown") & ~force, "version is set"),
    )
    staged = cut_lineage(old.select(
        "request_id", "dataset_id", "resolve_outcome", "canonical", errors.alias("errors"), changes_url.alias("changes_url"),
        "new_url", "new_version", effective.alias("new_provider"), "modalities", "old_modalities",
        values.normalized_aliases(F.col("aliases"), F.col("canonical")).alias("aliases"),
        (F.col("url").isNull() & F.col("provider").isNull() & F.col("version").isNull()).alias("only_adds"),
    ))
    # Rules are met in this order: the request itself, the lookup, replacing the URL, the URL's owner, set values, aliases.
    late = F.array(F.lit("url cannot be replaced"), F.lit("provider is set"), F.lit("version is set"))
    early = F.size(F.array_except("errors", late)) > 0
    keeps_url = F.array_contains("errors", "url cannot be replaced")
    sound = staged.filter((F.col("resolve_outcome") == "found") & (F.size("errors") == 0))
    taken_url = source_reference_conflicts(
        staged.filter((F.col("resolve_outcome") == "found") & ~early & ~keeps_url & F.col("changes_url")).select("request_id", "dataset_id", F.col("new_url").alias("source_reference")), datasets, aliases
    ).select("request_id", F.col("owner_id").alias("url_owner"))
    taken_alias = alias_conflicts(sound, datasets, aliases).groupBy("request_id").agg(
        F.min(F.struct("pos", "alias", "owner_id")).alias("hit")
    )
    free = cut_lineage(
        sound.join(taken_url.select("request_id"), "request_id", "left_anti").join(taken_alias.select("request_id"), "request_id", "left_anti")
    )
    # The first request of a dataset, and all that only add before the first one that does not.
    bounds = free.groupBy("dataset_id").agg(
        F.min("request_id").alias("first"), F.min(F.when(~F.col("only_adds"), F.col("request_id"))).alias("other")
    )
    in_turn = (F.col("request_id") == F.col("first")) | (F.col("only_adds") & F.coalesce(F.col("request_id") < F.col("other"), F.lit(True)))
    turn = cut_lineage(free.select("request_id", "dataset_id", "only_adds").join(bounds, "dataset_id").filter(in_turn).select("request_id"))
    current_turn = cut_lineage(free.join(turn, "request_id", "left_semi"))
    wanted = current_turn.select("request_id", "dataset_id", F.posexplode("aliases").alias("pos", "alias"))
    url_claims = current_turn.filter("changes_url").select(
        "request_id", F.col("request_id").alias("ord"), F.col("dataset_id").alias("holder"), F.concat(F.lit("value|"), "new_url").alias("key")
    )
    lost = settle_claims(_alias_claims(wanted).unionByName(url_claims)).filter(~F.col("accepted")).select(
        "request_id", F.lit(True).alias("lost")
    )
    applied = cut_lineage(current_turn.join(lost.select("request_id"), "request_id", "left_anti"))

    # At most one request of a dataset sets a URL, provider or version in a round; sets of modalities are small.
    added = applied.select("dataset_id", F.explode_outer("modalities").alias("added")).groupBy("dataset_id").agg(F.collect_set("added").alias("modalities"))
    changes = applied.groupBy("dataset_id").agg(
        *[F.max(c).alias(c) for c in ("new_url", "new_version", "new_provider")], F.first("old_modalities").alias("old_modalities")
    ).join(added, "dataset_id").withColumn("merged", values.merged_modalities(F.col("old_modalities"), F.col("modalities"))).drop(
        "old_modalities", "modalities"
    )
    next_rows = datasets.join(changes, "dataset_id").select(
        "dataset_id", "name", F.coalesce("new_provider", "provider").alias("provider"),
        F.coalesce("new_url", "source_url").alias("source_url"), F.coalesce("new_version", "version").alias("version"),
        F.col("merged").alias("modalities"), "size_bytes", "size_bytes_known", "status", "storage_path", "storage_mode", "created_at",
    )
    # A canonical URL may stand without an alias row, so only a stored alias makes this one superfluous.
    stored_urls = aliases.filter(F.col("kind") == "url").select("dataset_id", F.col("value").alias("new_url"))
    url_rows = applied.filter("changes_url").join(stored_urls, ["dataset_id", "new_url"], "left_anti").select(
        "dataset_id", F.lit("url").alias("kind"), F.col("new_url").alias("value")
    )
    granted = applied.select("request_id", "dataset_id", F.posexplode("aliases").alias("pos", "alias"))
    new_aliases = url_rows.unionByName(_new_alias_rows(granted, aliases))

    done = applied.select("request_id", F.lit(True).alias("done"))
    taken_turn = free.join(turn, "request_id", "left_anti").select("request_id", F.lit(True).alias("waits"))
    outcome = (
        F.when(early, "invalid").when(F.col("resolve_outcome") != "found", F.col("resolve_outcome"))
        .when(keeps_url, "rejected").when(F.col("url_owner").isNotNull(), "conflict").when(F.size("errors") > 0, "rejected")
        .when(F.col("hit").isNotNull() | F.col("lost"), "conflict")
        .when(F.col("waits"), "deferred").otherwise("accepted")
    )
    outcomes = (
        staged.join(taken_url, "request_id", "left").join(taken_alias, "request_id", "left").join(lost, "request_id", "left")
        .join(taken_turn, "request_id", "left").join(done, "request_id", "left")
        .select(
            "request_id", "dataset_id", outcome.alias("outcome"), F.array_join("errors", ", ").alias("errors"),
            F.coalesce("url_owner", "hit.owner_id").alias("owner_id"),
        )
    )
    return RegistryChange(next_rows, new_aliases, None, outcomes)


def storage_transitions(
    requests: DataFrame, datasets: DataFrame, sizes: DataFrame, managed_root: str = "/registry/datasets"
) -> RegistryChange:
    """Plan moving or copying referenced datasets into managed storage.

    ``sizes`` is (dataset_id, total_bytes). Of several sound requests for one dataset the first
    succeeds; the others meet a dataset that is no longer a reference.
    """
    facts = datasets.select("dataset_id", "name", "version", "storage_path", F.col("storage_mode").alias("old_mode"))
    judged = requests.join(facts, "dataset_id", "left").withColumn(
        "problem",
        F.when(~F.col("mode").isin("move", "copy"), "invalid").when(F.col("old_mode").isNull(), "not found")
        .when(F.col("old_mode") != "reference", "conflict").when(F.col("storage_path").isNull() | ~F.col("path_is_dir"), "invalid")
        .when(F.col("destination_exists"), "conflict"),
    )
    judged = cut_lineage(judged)
    sound = judged.filter("problem is null")
    winners = first_per_key(sound.select("request_id", "dataset_id"), ["dataset_id"], [F.col("request_id")]).select("request_id", F.lit(True).alias("wins"))
    done = judged.join(winners, "request_id", "left").withColumn(
        "outcome", F.coalesce("problem", F.when(F.col("wins"), "ok").otherwise("conflict"))
    )
    destination = paths.destination(managed_root, F.col("dataset_id"), F.col("name"), F.col("version"))
    moved = done.filter("outcome = 'ok'").select("dataset_id", F.col("mode").alias("new_mode"), destination.alias("new_path"))
    next_rows = datasets.join(moved, "dataset_id").join(sizes, "dataset_id", "left").select(
        *[F.col(c) for c in ("dataset_id", "name", "provider", "source_url", "version", "modalities")],
        F.coalesce("total_bytes", F.lit(0)).cast("bigint").alias("size_bytes"), F.lit(True).alias("size_bytes_known"), "status",
        F.col("new_path").alias("storage_path"), F.col("new_mode").alias("storage_mode"), "created_at",
    )
    jobs = done.filter("outcome = 'ok'").select(
        F.concat(F.lit("job-"), "request_id").alias("job_id"), "dataset_id", F.lit("succeeded").alias("status"),
        F.concat(F.lit("storage-transition-"), "mode").alias("mode"),
    )
    outcomes = done.select(
        "request_id", "dataset_id", "mode", "outcome", F.when(F.col("outcome") == "ok", destination).alias("new_path")
    )
    return RegistryChange(next_rows, datasets.select("dataset_id").limit(0), jobs, outcomes)


def ingest_audit(jobs: DataFrame) -> DataFrame:
    """Ingestion jobs by mode and status."""
    return jobs.groupBy("mode", "status").agg(
        F.count("*").alias("jobs"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")
    )
