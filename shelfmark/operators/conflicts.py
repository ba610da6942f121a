"""Identity conflicts between requests and registered datasets, and inside a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.tables import top_per_key
from shelfmark.operators.search import identity_claims, location_keys
from shelfmark.session import counted_cut, cut_lineage


def _key(namespace: str, value: Column) -> Column:
    return F.concat(F.lit(namespace + "|"), value)


def owner_keys(datasets: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, dataset_id, created_at) for every identity a registered dataset holds."""
    return identity_claims(datasets, aliases).join(datasets.select("dataset_id", "created_at"), "dataset_id")


def newest_owners(datasets: DataFrame, aliases: DataFrame) -> DataFrame:
    """The newest dataset behind every key: the one a conflict names."""
    return owner_keys(datasets, aliases).groupBy("key").agg(
        F.max(F.struct("created_at", "dataset_id")).alias("owner")
    )


def _alias_probes(aliases: Column) -> Column:
    """Probe structs of an alias list: an alias may not reuse an id, name, alias, URL or path."""
    return F.flatten(
        F.transform(
            aliases,
            lambda alias, i: F.array(
                *[
                    F.struct(F.lit("alias").alias("role"), i.alias("pos"), key.alias("key"), alias.alias("alias"))
                    for key in (_key("id", alias), _key("name", F.lower(alias)), _key("ref", alias))
                ]
            ),
        )
    )


def identity_probes(requests: DataFrame, *carried: str) -> DataFrame:
    """One row per key a request must not find taken: name, source reference and every alias."""
    none = F.lit(None).cast("string")
    own = F.array(
        F.struct(F.lit("name").alias("role"), F.lit(0).alias("pos"), _key("name", F.lower("name")).alias("key"), none.alias("alias")),
        F.struct(F.lit("source").alias("role"), F.lit(0).alias("pos"), _key("ref", F.col("source_reference")).alias("key"), none.alias("alias")),
    )
    probes = F.concat(own, _alias_probes(F.col("aliases")))
    return requests.select("request_id", *carried, F.explode(probes).alias("p")).select("request_id", *carried, "p.*")


def decide_conflicts(matched: DataFrame) -> DataFrame:
    """Reason, owner and alias per request from its probes with the owner each met, if any.

    A name or source conflict comes before an alias conflict; among several owners the newest
    counts, among several aliases the first. Requests that met no owner keep a null reason.
    """
    is_alias = F.col("role") == "alias"
    decided = matched.groupBy("request_id").agg(
        F.max(F.when(~is_alias & F.col("owner").isNotNull(), F.struct(
            F.col("owner.created_at").alias("created_at"), F.col("owner.dataset_id").alias("dataset_id"),
            F.when(F.col("role") == "name", 1).otherwise(0).alias("by_name"),
        ))).alias("own"),
        F.max(F.when(is_alias & F.col("owner").isNotNull(), F.struct(
            (-F.col("pos")).alias("first"), F.col("owner.created_at").alias("created_at"),
            F.col("owner.dataset_id").alias("dataset_id"), "alias",
        ))).alias("other"),
    )
    reason = (
        F.when(F.col("own.by_name") == 1, "name").when(F.col("own").isNotNull(), "source URL/path")
        .when(F.col("other").isNotNull(), "name alias")
    )
    return decided.select(
        "request_id", reason.alias("reason"),
        F.coalesce("own.dataset_id", "other.dataset_id").alias("owner_id"),
        F.when(F.col("own").isNull(), F.col("other.alias")).alias("alias"),
    )


def identity_conflicts(requests: DataFrame, datasets: DataFrame, aliases: DataFrame) -> DataFrame:
    """Check (request_id, name, source_reference, aliases) against the registry.

    Requests without any owner are ``accepted``; the others carry the newest owner's facts.
    """
    verdict = decide_conflicts(identity_probes(requests).join(newest_owners(datasets, aliases), "key", "left"))
    owners = datasets.select(
        F.col("dataset_id").alias("owner_id"), F.col("name").alias("owner_name"),
        F.col("version").alias("owner_version"), F.col("storage_path").alias("owner_path"),
    )
    return verdict.join(owners, "owner_id", "left").select(
        "request_id", F.when(F.col("reason").isNull(), "accepted").otherwise("conflict").alias("outcome"), "reason",
        "alias", "owner_id", "owner_name", "owner_version", "owner_path",
    )


def alias_conflicts(requests: DataFrame, datasets: DataFrame, aliases: DataFrame) -> DataFrame:
    """(request_id, dataset_id, aliases) whose alias belongs to another dataset, one row per alias."""
    probes = requests.select("request_id", "dataset_id", F.explode(_alias_probes(F.col("aliases"))).alias("p")).select(
        "request_id", F.col("dataset_id").alias("target_id"), "p.pos", "p.key", "p.alias"
    )
    matched = probes.join(newest_owners(datasets, aliases), "key")
    newest = matched.groupBy("request_id", "target_id", "pos", "alias").agg(F.max("owner").alias("owner"))
    return newest.filter(~F.col("owner.dataset_id").eqNullSafe(F.col("target_id"))).select(
        "request_id", F.col("target_id").alias("dataset_id"), "pos", "alias", F.col("owner.dataset_id").alias("owner_id")
    )


def source_reference_conflicts(requests: DataFrame, datasets: DataFrame, aliases: DataFrame) -> DataFrame:
    """(request_id, dataset_id, source_reference) already reserved by another dataset.

    The two newest holders of each reference decide: one of them is not the asking dataset.
    """
    held = (
        location_keys(datasets, aliases).select("location", "dataset_id").distinct()
        .join(datasets.select("dataset_id", "created_at"), "dataset_id")
    )
    pairs = top_per_key(held, ["location"], [F.col("created_at").desc(), F.col("dataset_id").desc()], 2)
    holders = pairs.groupBy("location").agg(
        F.max(F.when(F.col("rank") == 1, F.col("dataset_id"))).alias("newest"),
        F.max(F.when(F.col("rank") == 2, F.col("dataset_id"))).alias("next"),
    )
    asked = requests.select("request_id", F.col("dataset_id"), F.col("source_reference").alias("location"))
    other = F.when(~F.col("newest").eqNullSafe(F.col("dataset_id")), F.col("newest")).otherwise(F.col("next"))
    return asked.join(holders, "location").withColumn("owner_id", other).filter("owner_id is not null").select(
        "request_id", "dataset_id", F.col("location").alias("source_reference"), "owner_id"
    )


def constraint_violations(
    datasets: DataFrame, aliases: DataFrame, jobs: DataFrame, history: DataFrame
) -> DataFrame:
    """Rows a relational registry would refuse: repeated keys and children without a dataset."""
    def repeated(df: DataFrame, rule: str, subject: Column) -> DataFrame:
        return df.groupBy(subject.alias("subject")).agg(F.count("*").alias("rows")).filter("rows > 1").select(
            F.lit(rule).alias("rule"), "subject", "rows"
        )

    def orphans(df: DataFrame, rule: str) -> DataFrame:
        # Count children per id first: a hot id joins as one row.
        per_id = df.filter(F.col("dataset_id").isNotNull()).groupBy("dataset_id").agg(F.count("*").alias("rows"))
        return per_id.join(datasets.select("dataset_id"), "dataset_id", "left_anti").select(
            F.lit(rule).alias("rule"), F.col("dataset_id").alias("subject"), "rows"
        )

    located = datasets.filter(F.col("source_url").isNotNull())
    source_key = F.concat_ws("|", "provider", "source_url", "version")
    return (
        repeated(datasets, "dataset id repeats", F.col("dataset_id"))
        .unionByName(repeated(located, "source version repeats", source_key))
        .unionByName(repeated(aliases, "alias value repeats", F.col("value")))
        .unionByName(orphans(aliases, "alias without dataset"))
        .unionByName(orphans(jobs, "job without dataset"))
        .unionByName(orphans(history, "health check without dataset"))
    )


def settle_claims(claims: DataFrame) -> DataFrame:
    """Decide a batch of requests that claim the same keys, earliest first.

    ``claims`` is (request_id, ord, holder, key): a request loses if an earlier *accepted* request
    of another holder has one of its keys. Acceptance depends on acceptance, so it is settled in
    rounds over the shrinking rest: whoever is first on all its keys wins, whoever shares a key
    with a winner of another holder loses. Returns (request_id, accepted) for contested requests;
    a request not returned met no rival and is accepted.
    """
    contested = claims.groupBy("key").agg(
        F.min("holder").alias("_low"), F.max("holder").alias("_high")
    ).filter("_low <> _high").select("key")
    pending, left = counted_cut(claims.join(contested, "key", "left_semi"))
    decided = pending.select("request_id", F.lit(True).alias("accepted")).limit(0)
    while left:
        # Per key the earliest claims of the two earliest holders: everybody's first rival.
        firsts = pending.groupBy("key", "holder").agg(F.min("ord").alias("ord"))
        two = top_per_key(firsts, ["key"], [F.col("ord").asc(), F.col("holder").asc()], 2)
        leaders = two.groupBy("key").agg(
            F.max(F.when(F.col("rank") == 1, F.col("holder"))).alias("lead_holder"),
            F.max(F.when(F.col("rank") == 1, F.col("ord"))).alias("lead_ord"),
            F.max(F.when(F.col("rank") == 2, F.col("ord"))).alias("next_ord"),
        )
        rival = F.when(F.col("holder") == F.col("lead_holder"), F.col("next_ord")).otherwise(F.col("lead_ord"))
        verdicts = pending.join(leaders, "key").groupBy("request_id").agg(
            F.bool_and(F.coalesce(F.col("ord") < rival, F.lit(True))).alias("wins")
        )
        marked = cut_lineage(pending.join(verdicts, "request_id"))
        won, rest = marked.filter("wins"), marked.filter("not wins").drop("wins")
        # An accepted holder is unique per key: two accepted rivals would have met on it.
        taken = won.groupBy("key").agg(F.max("holder").alias("winner"))
        beaten = rest.join(taken, "key").filter(F.col("holder") != F.col("winner")).select("request_id").distinct()
        lost = cut_lineage(beaten)
        decided = decided.unionByName(won.select("request_id").distinct().withColumn("accepted", F.lit(True))).unionByName(
            lost.withColumn("accepted", F.lit(False))
        )
        pending, left = counted_cut(rest.join(lost, "request_id", "left_anti"))
    return decided
