"""Range, prefix and as-of lookups against small tables, and interval checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.addresses import address


def price_of(calls: DataFrame, prices: DataFrame, key: str, now_ms: int) -> DataFrame:
    """calls (key, model, provider) with the valid price of the longest model prefix; the provider's own come first.

    prices is (provider or null, prefix, valid_from_ms, price). It meets calls by equality: each model is cut into its
    prefixes of the lengths that prices have.
    """
    current = prices.filter(F.col("valid_from_ms") <= now_ms).groupBy(F.col("provider").alias("p_provider"), "prefix").agg(F.max_by("price", "valid_from_ms").alias("price"))
    models = calls.select("model").distinct()
    lengths = [r["n"] for r in current.select(F.length("prefix").alias("n")).distinct().collect()]  # a few: names are short
    cut = models.select("model", F.explode(F.array_distinct(F.array(*[F.substring("model", 1, n) for n in sorted(lengths)]) if lengths else F.array().cast("array<string>"))).alias("prefix"))
    found = calls.join(cut, "model").join(current, "prefix").filter(F.col("p_provider").isNull() | (F.col("p_provider") == F.col("provider")))
    best = found.groupBy(key).agg(F.max_by("price", F.struct(F.col("p_provider").isNotNull().alias("own"), F.length("prefix"))).alias("price"))
    return calls.join(best, key, "left")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the value of the last right row (key, at, value) not later, or null: one sort of both together."""
    both = left.select("*", F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias("v")).unionByName(
        right.select(key, at, F.lit(0).alias("side"), F.col(value).alias("v")), allowMissingColumns=True
    )
    so_far = Window.partitionBy(key).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("v", ignorenulls=True).over(so_far)).filter("side = 1").drop("side", "v")


def in_ranges(points: DataFrame, ranges: DataFrame, at: str, width: int) -> DataFrame:
    """points in the ranges [lo, hi] that hold them, by an equality join on cells of the given width."""
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    return points.withColumn("cell", F.floor(F.col(at) / width)).join(cells, "cell").filter(F.col(at).between(F.col("lo"), F.col("hi"))).drop("cell")


def country_of(visits: DataFrame, ranges: DataFrame, ip: str) -> DataFrame:
    """visits with the country of their address, empty where it is no address or lies in no range.

    ranges (v6, lo, hi, country) don't overlap; IPv6 bounds are of the first 64 bits, and those from 2^63 on are
    delegated to nobody. Ranges meet addresses by equality on their first 16 bits (IPv4) or 20 bits (IPv6), so the
    widest delegations, of 8 and 12 bits, stand in 256 cells.
    """
    cells = ranges.filter("not v6").withColumn("cell", F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright("hi", 16))))
    cells = cells.unionByName(ranges.filter("v6").withColumn("cell", F.explode(F.sequence(F.shiftright("lo", 44), F.shiftright("hi", 44)))))
    at = visits.withColumn("net", address(F.col(ip))).withColumn("net_cell", F.shiftright("net.at", 16))
    at = at.withColumn("net_cell", F.when(F.col("net.v6"), F.shiftright("net.at", 44)).otherwise(F.col("net_cell")))
    held = (F.col("net.v6") == F.col("v6")) & (F.col("net_cell") == F.col("cell")) & F.col("net.at").between(F.col("lo"), F.col("hi"))
    return at.join(cells, held, "left").withColumn("country", F.coalesce("country", F.lit(""))).drop("net", "net_cell", "v6", "lo", "hi", "cell")


def missed(checkins: DataFrame, now_ms: int, every_ms: int, grace_ms: int) -> DataFrame:
    """Monitors (monitor, ts_ms) whose last check-in is older than schedule and grace."""
    return checkins.groupBy("monitor").agg(F.max("ts_ms").alias("last_ms")).filter(F.col("last_ms") + every_ms + grace_ms < now_ms)


def overlapping(incidents: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Incidents (opened_ms, closed_ms or null) that touch [start, end)."""
    return incidents.filter((F.col("opened_ms") < end_ms) & (F.coalesce("closed_ms", F.lit(end_ms)) >= start_ms))
