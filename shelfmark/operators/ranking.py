"""Download node selection: eligibility, probe scores, ranking and failover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.functions.statistics import order_statistics
from shelfmark.session import cut_lineage


def eligible_nodes(proxies: DataFrame, marker: str = "") -> DataFrame:
    """Direct members of every group that carry the marker, or the reason a group has none."""
    groups = proxies.select(
        F.col("name").alias("group"), F.lower("type").alias("group_type"), "members"
    ).filter(F.col("group_type").isin(vocab.GROUP_PROXY_TYPES))
    refused = groups.filter("group_type <> 'selector'").select(
        "group", F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("node"), F.lit("not a selector").alias("problem")
    )
    types = proxies.select(F.col("name").alias("node"), F.lower("type").alias("node_type"))
    members = groups.filter("group_type = 'selector'").select("group", F.posexplode_outer("members").alias("position", "node"))
    judged = members.join(types, "node", "left").withColumn(
        "fits", F.coalesce(F.contains("node", F.lit(marker)), F.lit(False)) & ~F.coalesce(F.col("node_type").isin(vocab.GROUP_PROXY_TYPES), F.lit(False))
    )
    fitting = judged.filter("fits").select("group", "position", "node", F.lit(None).cast("string").alias("problem"))
    empty = judged.groupBy("group").agg(F.bool_or("fits").alias("any")).filter("not any").select(
        "group", F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("node"), F.lit("no direct node").alias("problem")
    )
    return fitting.unionByName(empty).unionByName(refused)


def discover_selector(connections: DataFrame, proxies: DataFrame, hostname: str) -> DataFrame:
    """Outermost selector behind the one new connection to a host, per discovery attempt.

    A connection without id, or a matching one without a chain, makes the attempt ``invalid``.
    """
    key = ["discovery_id", "id"]
    before = connections.filter("snapshot = 'before'").select(*key).distinct()
    host = hostname.lower()
    matches_host = F.lit(False)
    for field in ("host", "sniff_host", "destination_ip"):
        matches_host = matches_host | F.coalesce(F.lower(field) == host, F.lit(False))
    fresh = connections.filter((F.col("snapshot") == "after") & matches_host).join(before, key, "left_anti")
    bad_chain = (F.size("chains") < 1) | F.exists("chains", lambda hop: hop.isNull() | (hop == ""))
    counted = fresh.groupBy("discovery_id").agg(F.count("*").alias("matches"), F.bool_or(bad_chain).alias("bad_chain"))
    # Exactly one match per attempt goes on, so "the first" is that one.
    single = fresh.join(counted.filter("matches = 1").select("discovery_id"), "discovery_id", "left_semi")
    selectors = proxies.filter("lower(type) = 'selector'").select(F.col("name").alias("hop"))
    walked = single.select("discovery_id", F.posexplode("chains").alias("pos", "hop")).join(selectors, "hop")
    outer = walked.groupBy("discovery_id").agg(F.max_by("hop", "pos").alias("selector"))
    outcome = (
        F.when(F.col("nameless") > 0, "invalid").when(F.col("matches").isNull(), "none").when(F.col("matches") > 1, "ambiguous")
        .when(F.col("bad_chain"), "invalid").when(F.col("selector").isNull(), "no selector").otherwise("found")
    )
    return (
        connections.groupBy("discovery_id").agg(F.count_if(F.coalesce("id", F.lit("")) == "").alias("nameless"))
        .join(counted, "discovery_id", "left").join(outer, "discovery_id", "left")
        .select("discovery_id", F.coalesce("matches", F.lit(0)).alias("matches"), outcome.alias("outcome"), "selector")
    )


def latency_profiles(probes: DataFrame, phases: tuple[str, ...] = ("latency",)) -> DataFrame:
    """Successes, attempts, success ratio and exact median latency per node; null median where all failed."""
    used = probes.filter(F.col("phase").isin(*phases))
    counted = used.groupBy("node", "node_order").agg(F.count_if("ok").alias("successes"), F.count("*").alias("attempts"))
    medians = order_statistics(used.filter("ok"), "node", "value", {"median_latency": (0.5, "midpoint")})
    return counted.join(medians, "node", "left").select(
        "node", "node_order", "successes", "attempts", (F.col("successes") / F.col("attempts")).alias("success_ratio"), "median_latency"
    )


def node_scores(probes: DataFrame, latency_phases: tuple[str, ...] = ("latency",)) -> DataFrame:
    """Success over both phases, median throughput (0 where none) and nearest-rank p95 latency per node."""
    is_latency, is_speed = F.col("phase").isin(*latency_phases), F.col("phase") == "throughput"
    used = probes.filter(is_latency | is_speed)
    counted = used.groupBy("node", "node_order").agg(
        F.count_if(is_latency & F.col("ok")).alias("latency_successes"), F.count_if(is_latency).alias("latency_attempts"),
        F.count_if(is_speed & F.col("ok")).alias("throughput_successes"), F.count_if(is_speed).alias("throughput_attempts"),
    )
    latency = order_statistics(used.filter(is_latency & F.col("ok")), "node", "value", {"p95_latency": (0.95, "nearest")})
    speed = order_statistics(used.filter(is_speed & F.col("ok")), "node", "value", {"median_throughput": (0.5, "midpoint")})
    success = F.col("latency_successes") + F.col("throughput_successes")
    return counted.join(latency, "node", "left").join(speed, "node", "left").select(
        "node", "node_order", "latency_successes", "latency_attempts", "throughput_successes", "throughput_attempts",
        (success / (F.col("latency_attempts") + F.col("throughput_attempts"))).alias("overall_ratio"),
        F.coalesce("median_throughput", F.lit(0.0)).alias("median_throughput"), "p95_latency",
    )


def supplement_shortlist(profiles: DataFrame, real_profiles: DataFrame, size: int = vocab.SHORTLIST_SIZE) -> DataFrame:
    """Nodes that passed the cheap probes, filled up from the real probes to the shortlist size.

    The real probes come in candidate order and only as many as slots are left, so a top-``size``
    of each side is all that is ever ordered.
    """
    passing = profiles.filter("successes > 0")
    open_slots = profiles.agg(F.least(F.lit(size), F.count("*")) - F.count_if(F.col("successes") > 0)).scalar()
    fallback = (
        real_profiles.filter("successes > 0").join(passing.select("node"), "node", "left_anti")
        .orderBy("node_order").limit(size)
    )
    # The window orders at most ``size`` rows.
    ranked = fallback.withColumn("slot", F.row_number().over(W.orderBy("node_order")))
    kept = ranked.filter(F.col("slot") <= open_slots).select(*profiles.columns)
    return passing.withColumn("origin", F.lit("probe")).unionByName(kept.withColumn("origin", F.lit("real probe")))


def rank_nodes(profiles: DataFrame, scores: DataFrame, size: int = vocab.SHORTLIST_SIZE) -> DataFrame:
    """Shortlist by latency, then order by stability and speed; nodes without throughput drop out."""
    shortlist = profiles.filter("successes > 0").orderBy(
        F.col("success_ratio").desc(), F.col("median_latency").asc_nulls_last(), F.col("node_order").asc()
    ).limit(size).select("node")
    final = W.orderBy(
        F.col("throughput_successes").desc(), F.col("overall_ratio").desc(), F.col("median_throughput").desc(),
        F.col("p95_latency").asc_nulls_last(), F.col("node_order").asc(),
    )
    # At most ``size`` rows reach the single-task window.
    return scores.join(F.broadcast(shortlist), "node").filter("throughput_successes > 0").withColumn("rank", F.row_number().over(final)).select(
        "rank", "node", "throughput_successes", F.round("overall_ratio", 6).alias("overall_ratio"),
        F.round("median_throughput", 6).alias("median_throughput"), F.round("p95_latency", 6).alias("p95_latency"),
    )


def probe_throughput(chunks: DataFrame, limit: int = vocab.THROUGHPUT_SAMPLE_BYTES) -> DataFrame:
    """Bytes of every sample up to the limit and its rate in MiB/s; a sample without bytes or time is an error."""
    counted = chunks.groupBy("sample_id").agg(F.least(F.sum("bytes"), F.lit(limit)).alias("bytes"), F.max("seconds").alias("seconds"))
    problem = F.when(F.col("bytes") <= 0, "no bytes").when(F.col("seconds") <= 0, "no time")
    return counted.withColumn("problem", problem).withColumn(
        "mib_per_second",
        F.when(F.col("problem").isNull(), F.round(F.col("bytes") / F.lit(float(vocab.MIB)) / F.col("seconds"), 6)),
    )


def capped_samples(chunks: DataFrame, limit: int = vocab.THROUGHPUT_SAMPLE_BYTES) -> DataFrame:
    """Rate of every throughput sample up to the byte limit: (node, sample_id, ok, mib_per_second).

    ``chunks`` has node, sample_id, chunk_no, bytes and the seconds since the sample began. A
    sample ends with the chunk that brings it to the limit; what came after it does not count.
    Samples without bytes or time are not ok.
    """
    up_to = W.partitionBy("node", "sample_id").orderBy("chunk_no").rowsBetween(W.unboundedPreceding, -1)
    read = chunks.withColumn("_before", F.coalesce(F.sum("bytes").over(up_to), F.lit(0))).filter(F.col("_before") < limit)
    ended = read.groupBy("node", "sample_id").agg(F.least(F.sum("bytes"), F.lit(limit)).alias("bytes"), F.max("seconds").alias("seconds"))
    ok = F.coalesce((F.col("bytes") > 0) & (F.col("seconds") > 0), F.lit(False))
    rate = F.when(ok, F.col("bytes") / F.lit(float(vocab.MIB)) / F.col("seconds"))
    return ended.select("node", "sample_id", ok.alias("ok"), rate.alias("mib_per_second"))


def benchmark_groups(
    proxies: DataFrame, marker: str, cooldowns: DataFrame, probes: DataFrame, chunks: DataFrame, size: int = vocab.SHORTLIST_SIZE
) -> DataFrame:
    """Benchmark the nodes of every group: its ranking, or why it has none.

    Members that carry the marker and do not rest are candidates, in the order of the group. Those
    that passed the cheap probes (phase ``latency``) go on; where fewer than ``size`` did, candidates
    that passed a real probe (``real_latency``) fill up, in order. The ``size`` with the best success
    ratio and median latency are sampled for throughput under the byte limit and ranked as in
    ``rank_nodes``. Nodes are measured once, whatever the number of groups they are in; windows over
    a group keep no more than ``size`` rows beyond the map tasks.
    """
    by_group = lambda *order: F.row_number().over(W.partitionBy("group").orderBy(*order))
    eligible = eligible_nodes(proxies, marker)
    members = eligible.filter("node is not null").groupBy("group", "node").agg(F.min("position").alias("position"))
    resting = cooldowns.filter("not available").select("node")
    candidates = cut_lineage(members.join(resting, "node", "left_anti"))
    known = candidates.select("node").distinct()
    cheap = latency_profiles(probes.join(known, "node", "left_semi"))
    real = probes.filter("phase = 'real_latency' and ok").join(known, "node", "left_semi").groupBy("node").agg(F.min("value").alias("real_latency"))
    judged = cut_lineage(
        candidates.join(cheap.select("node", "successes", "attempts", "success_ratio", "median_latency"), "node", "left")
        .withColumn("passed", F.coalesce(F.col("successes") > 0, F.lit(False))).join(real, "node", "left")
    )
    open_slots = judged.groupBy("group").agg(
        (F.least(F.lit(size), F.count("*")) - F.count_if("passed")).alias("slots")
    ).filter("slots > 0")
    filling = judged.filter("not passed and real_latency is not null").withColumn("slot", by_group("position")).filter(F.col("slot") <= size)
    filled = filling.join(open_slots, "group").filter("slot <= slots").select(
        "group", "node", "position", F.lit(1.0).alias("ratio"), F.col("real_latency").alias("latency"),
        F.lit(1).cast("bigint").alias("latency_successes"), F.lit(1).cast("bigint").alias("latency_attempts"),
    )
    passing = judged.filter("passed").select(
        "group", "node", "position", F.col("success_ratio").alias("ratio"), F.col("median_latency").alias("latency"),
        F.col("successes").alias("latency_successes"), F.col("attempts").alias("latency_attempts"),
    ).unionByName(filled)
    shortlist = cut_lineage(
        passing.withColumn("place", by_group(F.desc("ratio"), F.asc("latency"), F.asc("position"))).filter(F.col("place") <= size).drop("place")
    )
    listed = shortlist.select("node").distinct()
    samples = cut_lineage(capped_samples(chunks.join(listed, "node", "left_semi")))
    counted = samples.groupBy("node").agg(F.count_if("ok").alias("throughput_successes"), F.count("*").alias("throughput_attempts"))
    speed = order_statistics(samples.filter("ok"), "node", "mib_per_second", {"median_throughput": (0.5, "midpoint")})
    timed = probes.filter("phase = 'latency' and ok").join(listed, "node", "left_semi")
    slow = order_statistics(timed, "node", "value", {"p95_latency": (0.95, "nearest")})
    scored = (
        shortlist.join(counted, "node").join(speed, "node").join(slow, "node", "left")
        .withColumn("p95_latency", F.coalesce("p95_latency", "latency"))
        .withColumn("overall_ratio", (F.col("latency_successes") + F.col("throughput_successes")) / (F.col("latency_attempts") + F.col("throughput_attempts")))
    )
    place = by_group(F.desc("throughput_successes"), F.desc("overall_ratio"), F.desc("median_throughput"), F.asc("p95_latency"), F.asc("position"))
    ranked = cut_lineage(scored.withColumn("rank", place).select("group", "rank", "node", "throughput_successes", "overall_ratio", "median_throughput", "p95_latency"))
    without = (
        eligible.groupBy("group").agg(F.max("problem").alias("refused"))
        .join(candidates.select("group").distinct().withColumn("awake", F.lit(True)), "group", "left")
        .join(shortlist.select("group").distinct().withColumn("probed", F.lit(True)), "group", "left")
        .join(ranked.select("group").distinct(), "group", "left_anti")
    )
    problem = F.coalesce(
        "refused", F.when(F.col("awake").isNull(), "all nodes rest").when(F.col("probed").isNull(), "no node passed the probes").otherwise("no node passed a speed test")
    )
    return ranked.withColumn("problem", F.lit(None).cast("string")).unionByName(
        without.select("group", problem.alias("problem")), allowMissingColumns=True
    )


def node_cooldowns(failures: DataFrame, now: str, cooldown: int = vocab.NODE_COOLDOWN_SECONDS) -> DataFrame:
    """Until when every failed node rests, and whether it is available at ``now``."""
    at = F.lit(now).cast("timestamp")
    return failures.filter(F.col("failed_at") <= at).groupBy("node").agg(
        F.count("*").alias("failures"), F.max("failed_at").alias("last_failure")
    ).select(
        "node", "failures", (F.unix_micros("last_failure") / F.lit(1e6) + cooldown).alias("rests_until"),
        ((F.unix_micros("last_failure") + cooldown * 1000000) <= F.unix_micros(at)).alias("available"),
    )


def _ranked_available(ranking: DataFrame, cooldowns: DataFrame) -> DataFrame:
    return ranking.select("rank", "node").join(cooldowns.select("node", "available"), "node", "left").withColumn(
        "available", F.coalesce("available", F.lit(True))
    )


def next_node(
    ranking: DataFrame, cooldowns: DataFrame, current: str | None, ranked_at: str | None, now: str, marker: str = ""
) -> DataFrame:
    """Node for the next attempt: the current one while it is good, else the best ranked, else rank anew."""
    state = _ranked_available(ranking, cooldowns).agg(
        F.count("*").alias("ranked"),
        F.coalesce(F.bool_or((F.col("node") == F.lit(current)) & F.contains("node", F.lit(marker)) & F.col("available")), F.lit(False)).alias("stays"),
        F.min_by("node", F.when(F.col("available"), F.col("rank"))).alias("best"),
    )
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.lit(ranked_at).cast("timestamp"))
    stale = F.lit(ranked_at).isNull() | (age >= vocab.RANKING_LIFETIME_SECONDS)
    action = F.when(stale | (F.col("ranked") == 0), "rank").when(F.col("stays"), "keep").when(F.col("best").isNotNull(), "switch").otherwise("rank")
    return state.select(action.alias("action"), F.when(action == "keep", F.lit(current)).when(action == "switch", F.col("best")).alias("node"))


def failover_choice(ranking: DataFrame, cooldowns: DataFrame, samples: DataFrame, failed: str) -> DataFrame:
    """After the failed node goes to rest: best ranked available node with a good sample, or none."""
    good = samples.filter("ok").groupBy("node").agg(F.lit(True).alias("sampled"))
    usable = _ranked_available(ranking, cooldowns).join(good, "node", "left").filter(
        (F.col("node") != failed) & F.col("available") & F.coalesce("sampled", F.lit(False))
    )
    return usable.agg(F.min_by("node", "rank").alias("node"), F.count("*").alias("candidates"))
