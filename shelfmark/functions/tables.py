"""Small table-level helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of every key; map tasks already drop the others before the shuffle."""
    return top_per_key(df, keys, order, 1, "_rank").drop("_rank")


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int, rank: str = "rank"
) -> DataFrame:
    """Keep the first ``count`` rows of every key with their rank."""
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= count)


def reason_list(*checks: tuple[Column, str]) -> Column:
    """Names of the checks that fail, in the given order."""
    return F.array_compact(F.array(*[F.when(failed, F.lit(reason)) for failed, reason in checks]))
