"""Search, resolve and serialize registered datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.functions import text, urls
from shelfmark.session import cut_lineage

NEWEST_FIRST = ("created_at", "dataset_id")


def visible(datasets: DataFrame) -> DataFrame:
    """Datasets a normal search may show."""
    return datasets.filter(~F.col("status").isin(vocab.HIDDEN_STATUSES))


def name_keys(datasets: DataFrame, aliases: DataFrame) -> DataFrame:
    """(dataset_id, label) for every name a dataset answers to."""
    canonical = datasets.select("dataset_id", F.col("name").alias("label"))
    other = aliases.filter(F.col("kind").isin(vocab.NAME_KINDS)).select("dataset_id", F.col("value").alias("label"))
    return canonical.unionByName(other)


def location_keys(datasets: DataFrame, aliases: DataFrame) -> DataFrame:
    """(dataset_id, kind, location) for every URL or path a dataset answers to."""
    canonical = datasets.filter(F.col("source_url").isNotNull()).select(
        "dataset_id", F.lit("url").alias("kind"), F.col("source_url").alias("location")
    )
    other = aliases.filter(F.col("kind").isin(vocab.LOCATION_KINDS)).select(
        "dataset_id", "kind", F.col("value").alias("location")
    )
    return canonical.unionByName(other)


def find_datasets(
    datasets: DataFrame,
    aliases: DataFrame,
    *,
    query: str | None = None,
    url: str | None = None,
    provider: str | None = None,
    modality: str | None = None,
    exact_modality: bool = False,
    show_all: bool = False,
) -> DataFrame:
    """Datasets that pass every given filter, newest first.

    ``query`` is contained in the name or a name alias, without regard to case; ``%`` and ``_``
    in it keep their wildcard meaning. ``modality`` is contained in the joined modality list
    (so ``eeg`` also finds ``ieeg``) unless ``exact_modality``.
    """
    found = datasets if show_all else visible(datasets)
    if provider:
        found = found.filter(F.col("provider") == provider)
    if modality:
        wanted = F.lit(modality.lower())
        whole = F.array_contains("modalities", wanted)
        found = found.filter(whole if exact_modality else F.lower(F.array_join("modalities", ",")).contains(wanted))
    if query:
        escaped = query.replace("\\", "\\\\")
        pattern = f"%{escaped}%"
        hits = (
            aliases.filter(F.col("kind").isin(vocab.NAME_KINDS) & F.col("value").ilike(pattern))
            .select("dataset_id", F.lit(True).alias("_hit")).distinct()
        )
        found = found.join(hits, "dataset_id", "left").filter(F.col("name").ilike(pattern) | F.col("_hit")).drop("_hit")
    if url:
        wanted = urls.identity_key(urls.parse(F.lit(url)))
        keyed = urls.with_parts(location_keys(found, aliases), F.col("location"))
        hits = keyed.filter(
            (F.col("location") == url)
            | ((F.col("kind") == "url") & F.coalesce(urls.identity_key(F.col("_u")) == wanted, F.lit(False)))
        ).select("dataset_id").distinct()
        found = found.join(hits, "dataset_id", "left_semi")
    return found.orderBy(F.col("created_at").desc(), F.col("dataset_id"))


# -- URL matching -----------------------------------------------------------------------------

def url_match_members(datasets: DataFrame, aliases: DataFrame) -> DataFrame:
    """(match_key, dataset_id): which datasets answer to a URL key.

    ``i|…`` keys are remote identities, ``x|…`` keys exact spellings. A request URL probes its
    identity key and its exact key; the members of the two never overlap, so counts add up.
    """
    keyed = urls.with_parts(location_keys(datasets, aliases), F.col("location")).select(
        "dataset_id", "kind", "location", urls.identity_key(F.col("_u")).alias("identity")
    )
    remote = F.concat(F.lit("i|"), "identity")
    exact = F.concat(F.lit("x|"), "location")
    # A path alias spelled like a remote URL matches exactly, but only the datasets its identity does not find.
    spelled = (F.col("kind") == "path") & F.col("identity").isNotNull()
    # With registered references a dataset may repeat under one key: count it once.
    members = keyed.filter(~spelled).select(F.coalesce(remote, exact).alias("match_key"), "dataset_id").distinct()
    extra = (
        keyed.filter(spelled).select(remote.alias("identity_key"), exact.alias("match_key"), "dataset_id").distinct()
        .join(members.withColumnRenamed("match_key", "identity_key"), ["identity_key", "dataset_id"], "left_anti")
        .select("match_key", "dataset_id")
    )
    return members.unionByName(extra)


def url_probe_keys(requests: DataFrame, url: str = "url") -> DataFrame:
    """Requests with the match keys their URL probes, one row per key."""
    probed = urls.with_parts(requests, F.col(url)).withColumn("_identity", urls.identity_key(F.col("_u")))
    keys = F.array_compact(F.array(F.concat(F.lit("i|"), "_identity"), F.concat(F.lit("x|"), url)))
    return probed.withColumn("match_key", F.explode_outer(keys)).drop("_u", "_identity")


def match_urls(requests: DataFrame, datasets: DataFrame, aliases: DataFrame) -> DataFrame:
    """How many datasets a requested URL names, and the newest of them.

    Members are counted per key before requests are joined, so a key that holds a third of all
    datasets costs each request one row, not one row per dataset. The members themselves are
    ``url_match_members``.
    """
    facts = datasets.select("dataset_id", "created_at")
    members = url_match_members(datasets, aliases).join(facts, "dataset_id")
    per_key = members.groupBy("match_key").agg(
        F.count("*").alias("members"),
        F.max(F.struct("created_at", "dataset_id")).alias("newest"),
    )
    probes = url_probe_keys(requests).select("request_id", "match_key")
    return (
        probes.join(per_key, "match_key", "left")
        .groupBy("request_id")
        .agg(F.coalesce(F.sum("members"), F.lit(0)).alias("match_count"), F.max("newest").alias("newest"))
        .select("request_id", "match_count", F.col("newest.dataset_id").alias("newest_dataset_id"))
    )


def ambiguous_urls(requests: DataFrame, datasets: DataFrame, aliases: DataFrame) -> DataFrame:
    """Candidates behind every URL that names several visible datasets.

    One row per (match key, dataset) with the number of ambiguous requests behind the key:
    requests that share a key share its candidates.
    """
    shown = visible(datasets)
    # Read three times below, so written once.
    members = cut_lineage(url_match_members(shown, aliases.join(shown.select("dataset_id"), "dataset_id", "left_semi")))
    per_key = members.groupBy("match_key").agg(F.count("*").alias("members"))
    probes = url_probe_keys(requests).select("request_id", "match_key").join(per_key, "match_key")
    ambiguous = probes.groupBy("request_id").agg(
        F.sum("members").alias("total"), F.collect_list("match_key").alias("match_keys")  # at most two keys
    ).filter("total > 1")
    wanted = ambiguous.select(F.explode("match_keys").alias("match_key")).groupBy("match_key").agg(
        F.count("*").alias("requests")
    )
    size = F.when(F.col("size_bytes_known"), F.col("size_bytes"))
    return (
        members.join(wanted, "match_key").join(shown, "dataset_id")
        .select(
            "match_key", "requests", "dataset_id", "name", F.array_join("modalities", ", ").alias("modalities"),
            "source_url", size.alias("size_bytes"), text.size_label(size).alias("size_label"),
        )
    )


# -- Identifiers ------------------------------------------------------------------------------

def identity_claims(datasets: DataFrame, aliases: DataFrame) -> DataFrame:
    """(dataset_id, key) for every id, name, URL and path a dataset answers to, one pass per table."""
    def key(namespace: str, value) -> Column:
        return F.concat(F.lit(namespace + "|"), value)

    own = datasets.select(
        "dataset_id",
        F.explode(F.array(key("id", F.col("dataset_id")), key("name", F.lower("name")), key("ref", F.col("source_url")))).alias("key"),
    )
    named = F.when(F.col("kind").isin(vocab.NAME_KINDS), key("name", F.lower("value"))).when(
        F.col("kind").isin(vocab.LOCATION_KINDS), key("ref", F.col("value"))
    )
    other = aliases.select("dataset_id", named.alias("key"))
    return own.unionByName(other).filter("key is not null")


def identifier_owners(datasets: DataFrame, aliases: DataFrame) -> DataFrame:
    """Lowest and highest dataset id behind every identifier key; equal where the key is unique."""
    located = urls.with_parts(location_keys(datasets, aliases), F.col("location"))
    remote = F.when(F.col("kind") == "url", F.concat(F.lit("i|"), urls.identity_key(F.col("_u"))))
    by_url = located.select("dataset_id", F.explode(F.array(remote, F.concat(F.lit("x|"), "location"))).alias("key"))
    return (
        identity_claims(datasets, aliases).unionByName(by_url.filter("key is not null"))
        .groupBy("key").agg(F.min("dataset_id").alias("low"), F.max("dataset_id").alias("high"))
    )


def resolve_identifiers(requests: DataFrame, datasets: DataFrame, aliases: DataFrame) -> DataFrame:
    """Resolve (identifier | name | url) requests to one dataset each.

    The five ways an identifier may match become keys of one table and one equi-join. An
    identifier that looks like a remote URL is matched as a URL only.
    """
    given = F.size(F.array_compact(F.array(*[F.nullif(F.col(c), F.lit("")) for c in ("identifier", "name", "url")])))
    staged = urls.with_parts(requests, F.coalesce(F.nullif("url", F.lit("")), F.col("identifier"))).withColumn(
        "_identity", urls.identity_key(F.col("_u"))
    ).withColumn("_given", given)
    by_url = F.coalesce(F.col("url") != "", F.lit(False)) | (
        F.coalesce(F.col("identifier") != "", F.lit(False)) & F.col("_identity").isNotNull()
    )
    location = F.coalesce(F.nullif("url", F.lit("")), F.col("identifier"))
    label = F.coalesce(F.nullif("identifier", F.lit("")), F.col("name"))
    keys = (
        F.when(F.col("_given") != 1, F.array().cast("array<string>"))
        .when(by_url, F.array(F.concat(F.lit("i|"), "_identity"), F.concat(F.lit("x|"), location)))
        .when(
            F.coalesce(F.col("identifier") != "", F.lit(False)),
            F.array(
                F.concat(F.lit("id|"), "identifier"), F.concat(F.lit("name|"), F.lower("identifier")),
                F.concat(F.lit("ref|"), "identifier"),
            ),
        )
        .otherwise(F.array(F.concat(F.lit("name|"), F.lower(label))))
    )
    probes = staged.select("request_id", "_given", F.explode_outer(F.array_compact(keys)).alias("key"))
    resolved = (
        probes.join(identifier_owners(datasets, aliases), "key", "left")
        .groupBy("request_id")
        .agg(F.max("_given").alias("given"), F.min("low").alias("low"), F.max("high").alias("high"))
    )
    outcome = (
        F.when(F.col("given") != 1, "invalid").when(F.col("low").isNull(), "not found")
        .when(F.col("low") != F.col("high"), "ambiguous").otherwise("found")
    )
    return resolved.select("request_id", outcome.alias("outcome"), F.when(outcome == "found", F.col("low")).alias("dataset_id"))


# -- Batch name search ------------------------------------------------------------------------

#: Names of one piece that meet its needles in one place.
POSTED_TOGETHER = 20_000


def _needle_pieces(needles: DataFrame) -> DataFrame:
    """Distinct folded needles with every piece of their search width.

    The width is three letters, or the longest run between wildcards where that is shorter.
    """
    runs = needles.select(F.lower("needle").alias("needle")).distinct().select(
        "needle", F.explode(F.split("needle", "[%_]+")).alias("run")
    )
    widths = runs.groupBy("needle").agg(F.least(F.lit(3), F.max(F.length("run"))).alias("width"))
    cut = runs.join(widths, "needle").filter("length(run) >= width").select(
        "needle", "width", "run", F.explode(F.expr("sequence(1, greatest(length(run) - width + 1, 1))")).alias("at")
    )
    return cut.select("needle", "width", F.expr("substr(run, at, width)").alias("gram")).distinct()


def _label_pieces(label: Column) -> Column:
    """The distinct pieces of one to three letters that a name holds, with their width."""
    folded = F.lower(label)
    spots = F.sequence(F.lit(1), F.length(folded))

    def of_width(width: int) -> Column:
        return F.transform(spots, lambda at: F.struct(F.lit(width).alias("width"), F.substring(folded, at, F.lit(width)).alias("gram")))

    pieces = [of_width(width) for width in (1, 2, 3)]
    return F.filter(F.array_distinct(F.concat(*pieces)), lambda p: F.length(p["gram"]) == p["width"])


def _wildcard_counts(needles: DataFrame, labels: DataFrame, created: DataFrame) -> DataFrame:
    """Matches of needles of wildcards only: names with at least as many letters as they have ``_``.

    Datasets are counted by the length of their longest name, so a needle meets lengths, not names.
    """
    longest = labels.groupBy("dataset_id").agg(F.max(F.length("label")).alias("letters")).join(created, "dataset_id")
    lengths = longest.groupBy("letters").agg(F.count("*").alias("datasets"), F.max(F.struct("created_at", "dataset_id")).alias("newest"))
    asked = needles.select(F.lower("needle").alias("needle")).distinct().filter(F.col("needle").rlike(r"^[%_]*$")).select(
        "needle", F.length(F.replace("needle", F.lit("%"), F.lit(""))).alias("least")
    )
    kinds = asked.select("least").distinct()
    counted = kinds.join(lengths, F.col("letters") >= F.col("least")).groupBy("least").agg(
        F.sum("datasets").alias("match_count"), F.max("newest").alias("newest")
    )
    return asked.join(counted, "least").select(F.col("needle").alias("_folded"), "match_count", "newest")


def search_by_name(needles: DataFrame, datasets: DataFrame, aliases: DataFrame) -> DataFrame:
    """Count the datasets every needle finds in names and name aliases, and name the newest.

    A needle is looked up by its rarest piece of three letters (or its longest shorter piece).
    Pieces are counted first, without the names that hold them; then names are cut into the pieces
    that were chosen only. A needle that is nothing but its piece takes the datasets of the piece as
    they are counted, and one of wildcards takes them by the length of their names; all others are
    compared in full with the names of their piece. The names of a piece that many hold are split
    into parts of ``POSTED_TOGETHER``, each of which meets the needles of the piece in a place of its own.
    """
    labels = name_keys(datasets, aliases).select("dataset_id", "label")
    created = datasets.select("dataset_id", "created_at")
    asked = cut_lineage(_needle_pieces(needles).filter("width > 0"))
    used = asked.select("width", "gram").distinct()
    cut = labels.select("dataset_id", "label", F.explode(_label_pieces(F.col("label"))).alias("p")).select("dataset_id", "label", "p.*")
    frequency = cut.select("width", "gram").groupBy("width", "gram").agg(F.count("*").alias("frequency")).join(used, ["width", "gram"], "left_semi")
    chosen = cut_lineage(
        asked.join(frequency, ["width", "gram"])
        .groupBy("needle", "width").agg(F.min(F.struct("frequency", "gram")).alias("best"), F.count("*").alias("found"))
        .join(asked.groupBy("needle").agg(F.count("*").alias("pieces")), "needle").filter("found = pieces")
        .select("needle", "width", "best.gram", "best.frequency", (F.col("needle") == F.col("best.gram")).alias("whole"))
    )
    posted = cut.join(chosen.select("width", "gram").distinct(), ["width", "gram"], "left_semi")
    of_piece = (
        posted.join(chosen.filter("whole").select("width", "gram").distinct(), ["width", "gram"], "left_semi")
        .select("width", "gram", "dataset_id").distinct().join(created, "dataset_id")
        .groupBy("width", "gram").agg(F.count("*").alias("match_count"), F.max(F.struct("created_at", "dataset_id")).alias("newest"))
    )
    plain = chosen.filter("whole").join(of_piece, ["width", "gram"]).select(F.col("needle").alias("_folded"), "match_count", "newest")

    compared = chosen.filter("not whole").withColumn("parts", F.ceil(F.col("frequency") / POSTED_TOGETHER))
    parts = compared.select("width", "gram", "parts").distinct()
    split = posted.join(parts, ["width", "gram"]).withColumn("part", F.pmod(F.xxhash64("dataset_id", "label"), F.col("parts")))
    spread = compared.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    hits = (
        split.drop("parts").join(spread.select("width", "gram", "part", "needle"), ["width", "gram", "part"])
        .filter(F.ilike("label", F.concat(F.lit("%"), F.replace("needle", F.lit("\\"), F.lit("\\\\")), F.lit("%"))))
        .select("needle", "dataset_id").distinct()
    )
    full = hits.join(created, "dataset_id").groupBy(F.col("needle").alias("_folded")).agg(
        F.count("*").alias("match_count"), F.max(F.struct("created_at", "dataset_id")).alias("newest")
    )
    counted = full.unionByName(plain).unionByName(_wildcard_counts(needles, labels, created))
    return needles.join(counted, F.lower("needle") == F.col("_folded"), "left").select(
        "request_id", "needle", F.coalesce("match_count", F.lit(0)).alias("match_count"),
        F.col("newest.dataset_id").alias("newest_dataset_id"),
    )


# -- Serialized records -----------------------------------------------------------------------

def alias_rollup(aliases: DataFrame) -> DataFrame:
    """Every alias of a dataset once per kind, one row each; ``write_documents`` puts them in order."""
    return aliases.filter(F.col("value").isNotNull()).select("dataset_id", "kind", "value").distinct()


def serialize_datasets(datasets: DataFrame, aliases: DataFrame) -> DataFrame:
    """Public records, one per dataset: hidden columns gone, unknown sizes null, aliases counted by kind.

    The aliases themselves are the rows of ``alias_rollup``, so a record has one form however
    many aliases its dataset has.
    """
    public_kinds = {"name_alias": "aliases", "url": "url_aliases", "path": "path_aliases"}
    counts = alias_rollup(aliases).groupBy("dataset_id").agg(
        *[F.count(F.when(F.col("kind") == kind, True)).alias(name) for kind, name in public_kinds.items()]
    )
    size = F.when(F.col("size_bytes_known"), F.col("size_bytes"))
    return datasets.join(counts, "dataset_id", "left").select(
        "dataset_id", "name", "provider", "source_url", "version", "modalities", size.alias("size_bytes"), "status",
        "storage_path", "storage_mode", *[F.coalesce(name, F.lit(0)).alias(name) for name in public_kinds.values()],
        text.size_label(size).alias("size_label"),
    )
