"""Exact values at a rank, without gathering a group's values in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def floored_ranks(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and, for each name, the value at index floor((n - 1) * share) of the group's ordered values, nulls left out.

    Equal values are counted first, map-side, so that a window holds the distinct values of a group only.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("times_"))
    group = Window.partitionBy(*by)
    ranked = counts.withColumn("upto_", F.sum("times_").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all_", F.sum("times_").over(group))
    return ranked.groupBy(*by).agg(*[F.min(F.when(F.col("upto_") > F.floor((F.col("all_") - 1) * F.lit(share)), F.col(value))).alias(name) for name, share in shares.items()])
