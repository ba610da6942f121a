"""Exact order statistics per key without holding a key's values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.session import cut_lineage

OCTAVE_BUCKETS = 64
#: Parts that a crowded bucket is cut into, and the values from which a bucket is crowded.
FANOUT, CROWDED = 1024, 4096


def _ranks(wanted: dict[str, tuple[float, str]], total: Column) -> Column:
    """(name, rank) of every value that is asked for, ranks from 1."""
    ranks = []
    for name, (fraction, mode) in wanted.items():
        if mode == "nearest":
            places = [F.greatest(F.lit(1), F.ceil(F.lit(fraction) * total))]
        else:
            position = F.lit(fraction) * (total - 1)
            places = [F.floor(position) + 1, F.ceil(position) + 1]
        ranks += [F.struct(F.lit(name).alias("name"), place.cast("bigint").alias("rank")) for place in places]
    return F.array(*ranks)


def _located(counted: DataFrame, ranks: DataFrame, groups: list[str], part: str) -> DataFrame:
    """Which part of its group each rank falls into, and how many values lie in the parts before it.

    ``counted`` has a row per group and part with ``n``, ``low`` and ``high``, so the window sees counts only.
    """
    running = W.partitionBy(*groups).orderBy(part).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = counted.withColumn("_upto", F.sum("n").over(running)).withColumn("_start", F.col("_upto") - F.col("n"))
    return ranks.join(placed, groups).filter((F.col("rank") > F.col("_start")) & (F.col("rank") <= F.col("_upto")))


def order_statistics(df: DataFrame, key: str, value: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """Exact medians and nearest-rank percentiles of non-null values per key.

    ``wanted`` maps an output name to (fraction, ``"midpoint"`` or ``"nearest"``). A first pass
    counts values per octave bucket, which combines in the map tasks and tells the bucket each
    wanted rank lies in. A bucket that is still crowded and holds more than one value is cut into
    ``FANOUT`` parts of equal width, and so on, until what is left of it can be ordered in one
    task; equal values are counted together. The values as a whole are never shuffled, and no
    window sees more than ``CROWDED`` values or one count per part.
    """
    # Monotone in the value: sign, then the logarithm of the magnitude.
    octave = F.signum("_v") * F.floor((F.log2(F.abs(F.col("_v")) + 1.0) + 1.0) * OCTAVE_BUCKETS)
    rows = df.filter(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_v")).withColumn(
        "_b", octave.cast("bigint").cast("string")
    )
    counts = lambda frame, *by: frame.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")
    )
    first = counts(rows.withColumn("_part", F.col("_b").cast("bigint")), key, "_part").withColumn("_total", F.sum("n").over(W.partitionBy(key)))
    asked = first.select(key, F.explode(_ranks(wanted, F.col("_total"))).alias("_r")).select(key, "_r.name", "_r.rank").distinct()
    # One row per key and wanted rank; written, so that the planner sees how small it is.
    targets = cut_lineage(_located(first.drop("_total"), asked, [key], "_part").select(
        key, "name", F.col("_part").cast("string").alias("_b"), (F.col("rank") - F.col("_start")).alias("rank"), "n", "low", "high"
    ))
    crowded = (F.col("n") > CROWDED) & (F.col("low") < F.col("high"))
    settled = targets.filter(~crowded)
    while (open_ := targets.filter(crowded)).head() is not None:
        bounds = open_.select(key, "_b", "low", "high").distinct()
        part = F.least(F.lit(FANOUT - 1), F.floor((F.col("_v") - F.col("low")) / (F.col("high") - F.col("low")) * FANOUT)).cast("int")
        cut = rows.join(bounds, [key, "_b"]).withColumn("_part", part).drop("low", "high")
        ranks = open_.select(key, "_b", "name", "rank")
        path = F.concat_ws("/", "_b", F.col("_part").cast("string"))
        targets = cut_lineage(_located(counts(cut, key, "_b", "_part"), ranks, [key, "_b"], "_part").select(
            key, "name", path.alias("_b"), (F.col("rank") - F.col("_start")).alias("rank"), "n", "low", "high"
        ))
        settled = settled.unionByName(targets.filter(~crowded))
        rows = rows.unionByName(cut.select(key, "_v", path.alias("_b")))
    # A bucket of one value answers by itself; of the others the values are ordered, equal ones as one.
    alone = settled.filter("low = high").select(key, "name", F.col("low").alias("_v"))
    several = settled.filter("low < high")
    inside = W.partitionBy(key, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ordered = (
        rows.join(several.select(key, "_b").distinct(), [key, "_b"]).groupBy(key, "_b", "_v").agg(F.count("*").alias("_n"))
        .withColumn("_high", F.sum("_n").over(inside)).withColumn("_low", F.col("_high") - F.col("_n"))
    )
    picked = several.select(key, "name", "_b", "rank").join(ordered, [key, "_b"]).filter(
        (F.col("rank") > F.col("_low")) & (F.col("rank") <= F.col("_high"))
    ).select(key, "name", "_v")
    return alone.unionByName(picked).groupBy(key).agg(
        *[F.avg(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in wanted]
    )
