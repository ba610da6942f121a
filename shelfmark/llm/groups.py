"""Connected groups of similar things: candidate links inside buckets, and components of links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shelfmark.llm.common import met_by, removed_dirs, stored, working_dir

#: Links, or rows of buckets, that one task takes through a round, at most.
FEW_LINKS = 1 << 17


def dealt(rows: DataFrame, few: bool) -> DataFrame:
    """Few rows as one partition, so that what follows needs no shuffle; others as they are."""
    return rows.coalesce(1) if few else rows


def components(links: DataFrame) -> DataFrame:
    """``node`` and the least node reachable over ``links`` (columns a, b) as ``root``.

    Every round hangs each node below the least neighbour it knows, first upwards, then
    downwards, until no link changes; rounds grow with the logarithm of the longest chain. A
    round keeps one row per link and finds least neighbours by aggregates that combine in the
    map tasks, so a node with very many links gathers nowhere. Each round is written to the
    shared folder. Nodes without links are not listed. Rounds of at most ``FEW_LINKS`` links are
    taken by one task, without shuffles, since each stage and task costs a record of the driver,
    a piece of the event log and files on disk, however few rows it has.
    """
    spark = links.sparkSession
    pairs = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m"))
    seen: tuple | None = None
    path = before = None
    while True:
        before, path = path, working_dir(spark, "links")
        look = Observation()
        pairs.observe(
            look, F.count("*").alias("rows"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")).alias("mark")
        ).write.parquet(path)
        now = (look.get["rows"], look.get["mark"])
        pairs = spark.read.schema(pairs.schema).parquet(path)
        if before is not None:
            removed_dirs(spark, [before])  # this round no longer reads it
        if now == seen or not now[0]:
            break
        seen = now
        few = now[0] <= FEW_LINKS
        both = pairs.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(
            pairs.select(F.col("m").alias("u"), F.col("v").alias("w"))
        )
        both = dealt(both, few)
        least = both.groupBy("u").agg(F.min("w").alias("low")).select("u", F.least("u", "low").alias("low"))
        hung = both.where("w > u").join(least, "u").select(F.col("w").alias("v"), F.col("low").alias("m")).distinct()
        lowest = hung.groupBy("v").agg(F.min("m").alias("low"))
        raised = hung.join(lowest, "v")
        pairs = dealt(
            raised.where("m != low").select(F.col("m").alias("v"), F.col("low").alias("m"))
            .unionByName(lowest.select("v", F.col("low").alias("m"))),
            few,
        ).distinct()
    pairs = dealt(pairs, (now[0] or 0) <= FEW_LINKS)
    roots = pairs.select(F.col("v").alias("node"), F.col("m").alias("root"))
    both = roots.unionByName(pairs.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())
    return dealt(both, (now[0] or 0) <= FEW_LINKS)


def crowded(members: DataFrame, fit: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The distinct (bucket, node) rows of buckets, 64-bit numbers, that more than one row falls into.

    Rows may carry a ``trait`` of their node, with which ``fit`` tells that two nodes cannot be
    similar. A bucket of two such nodes, as chance makes them, is left out at once.
    """
    full = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    met = stored(met_by(members, "bucket", stored(full, "full")).select(*members.columns).distinct(), "members")
    if fit is None:
        return met
    one = F.struct("node", "trait")
    hopeful = met.groupBy("bucket").agg(F.count("*").alias("n"), F.min(one).alias("low"), F.max(one).alias("high")).where(
        (F.col("n") > 2) | ((F.col("n") == 2) & fit(F.col("low.trait"), F.col("high.trait")))
    )
    return stored(met.join(hopeful.select("bucket"), "bucket", "left_semi"), "hopeful")


def similar_groups(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame],
    fit: Callable[[Column, Column], Column] | None = None, traits: Callable[[DataFrame], DataFrame] | None = None,
    verify_fit: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Connected groups of nodes that meet in a bucket and are similar: ``node`` and ``root``.

    ``members`` are rows of ``crowded``; ``verify`` takes pairs (a, b) and returns the
    similar ones, ``verify_fit`` (by default the same) does so for pairs that passed ``fit``. First
    each member is compared with the least node of its bucket, so a bucket
    of copies costs one comparison a member. Members that are not connected by that are compared
    with another node of the bucket, and so on, as long as open buckets hold more pairs of different
    groups than nodes and a round lessens them. Where members carry no traits, a node is compared
    in a round only with that of its buckets' chosen nodes which it meets in the most buckets, so a
    round has no more pairs than nodes; there are two rounds at least. At last all pairs of
    different groups in a bucket are compared. Two similar members of one bucket thus always end up in one group,
    whatever the rounds did, and no bucket emits pairs inside a group.
    ``fit`` tells by traits, without a text, that two nodes cannot be similar; such pairs cost no
    row. Traits are a column of ``members``, or ``traits`` (nodes to node, trait) gives them for the
    last comparison only; without ``fit`` all pairs of different groups are compared.
    Where members are few, one task finds the pairs of a round; their texts are compared by all.
    """
    if fit is None:
        fit, members = lambda a, b: F.lit(True), members.withColumn("trait", F.lit(0))
    carried = "trait" in members.columns
    few, tasks = members.count() <= FEW_LINKS, members.sparkSession.sparkContext.defaultParallelism
    placed = dealt(members, few).withColumn("root", F.col("node"))
    tried = links = None
    open_before, rounds = None, 0
    while True:
        apart = stored(_several_groups(placed), "loose")
        loose = dealt(apart, few)
        open_pairs = _pairs_across(loose)
        lessened = rounds < (1 if carried else 2) or open_pairs <= 0.9 * open_before
        if rounds and (not lessened or open_pairs <= loose.select("node").distinct().count()):
            break
        rounds += 1
        # The least node first, so that many buckets share it; later any member, the same for all buckets.
        rank = F.col("node") if links is None else F.xxhash64("node", F.lit(open_pairs))
        first = loose.groupBy("bucket").agg(F.min(F.struct(rank.alias("rank"), *[c for c in loose.columns if c != "bucket"])).alias("first"))
        chosen = F.col("root") != F.col("first.root")
        if carried:
            chosen = chosen & fit(F.col("trait"), F.col("first.trait"))
        both = (F.least("node", "first.node").alias("a"), F.greatest("node", "first.node").alias("b"))
        stars = loose.join(first, "bucket").where(chosen)
        stars = stars.select(*both).distinct() if carried else stars.groupBy("node", *both).agg(F.count("*").alias("met"))
        stars = stars if tried is None else stars.join(dealt(tried, few), ["a", "b"], "left_anti")
        if not carried:
            best = F.max(F.struct("met", "a", "b")).alias("best")
            stars = stars.groupBy("node").agg(best).select("best.a", "best.b").distinct()
        stars = stored(stars.repartition(tasks) if few else stars, "stars")
        found = stored(verify(stars).select("a", "b"), "verified")
        tried = stars if tried is None else tried.unionByName(stars)
        links = found if links is None else links.unionByName(found)
        grouped = components(links)
        placed = dealt(members, few).join(dealt(grouped, few), "node", "left").withColumn("root", F.coalesce("root", "node")).select(*members.columns, "root")
        open_before = open_pairs
        if not open_pairs:
            return grouped
    if not open_pairs:
        return grouped
    loose = apart  # few rows may still have many pairs, which all tasks share
    if not carried:
        loose = loose.join(traits(stored(loose.select("node").distinct(), "nodes")), "node")
    loose = loose.join(loose.groupBy("node").agg(F.collect_set("bucket").alias("buckets")), "node")
    left = loose.select("bucket", *[F.col(c).alias(f"a_{c}") for c in ("node", "root", "trait", "buckets")])
    right = loose.select(*[F.col(c).alias(f"b_{c}") for c in ("bucket", "node", "root", "trait", "buckets")])
    # A pair that meets in many buckets is taken in the least of them.
    met = (F.col("bucket") == F.col("b_bucket")) & (F.col("a_root") < F.col("b_root")) & fit(F.col("a_trait"), F.col("b_trait"))
    least = F.col("bucket") == F.array_min(F.array_intersect("a_buckets", "b_buckets"))
    across = (
        left.join(right, met & least).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
        .join(tried, ["a", "b"], "left_anti")
    )
    more = (verify_fit or verify)(stored(across, "across"))
    return components(links.unionByName(more.select("a", "b")))


def _several_groups(placed: DataFrame) -> DataFrame:
    """The rows of buckets whose nodes are not all in one group."""
    apart = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    return placed.join(apart.select("bucket"), "bucket", "left_semi")


def _pairs_across(loose: DataFrame) -> float:
    """How many pairs of different groups the buckets hold."""
    groups = loose.groupBy("bucket", "root").agg(F.count("*").cast("double").alias("n"))
    buckets = groups.groupBy("bucket").agg((F.pow(F.sum("n"), 2) - F.sum(F.col("n") * F.col("n"))).alias("twice"))
    return buckets.agg(F.coalesce(F.sum("twice"), F.lit(0.0)).alias("twice")).first()["twice"] / 2
