"""Metric points (stream, ts_ms, value): reductions, counter rates and histogram quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(step_ms: int) -> Column:
    return F.expr(f"(ts_ms div {step_ms}) * {step_ms}").alias("bucket_ms")


def reduced(points: DataFrame, how: str, step_ms: int, *by: str) -> DataFrame:
    """(bucket_ms, value): last, avg, sum, min or max of the points of each step; last takes the newest point."""
    value = {"avg": F.avg("value"), "sum": F.sum("value"), "min": F.min("value"), "max": F.max("value"), "last": F.max_by("value", F.struct("ts_ms", "event_id"))}[how]
    return points.groupBy(*by, _bucket(step_ms)).agg(value.alias("value"))


def labelled(points: DataFrame, equals: dict[str, str] | None = None, any_of: dict[str, list[str]] | None = None) -> DataFrame:
    """Points whose attributes (a map) have these labels with these values; an absent label has no value, not an empty one."""
    for key, values in ({k: [v] for k, v in (equals or {}).items()} | (any_of or {})).items():
        points = points.filter(F.col("attributes")[key].isin(values))
    return points


def with_labels(points: DataFrame, *labels: str) -> DataFrame:
    """Points with some of their labels as columns, to group by; an absent label is null, which is not the empty one."""
    return points.withColumns({k: F.col("attributes")[k] for k in labels})


def latest(points: DataFrame, *by: str) -> DataFrame:
    """(by, value, ts_ms): the newest point of each group, the last by event_id among equal times."""
    return points.groupBy(*by).agg(F.max_by("value", F.struct("ts_ms", "event_id")).alias("value"), F.max("ts_ms").alias("ts_ms"))


def listed(points: DataFrame) -> DataFrame:
    """(metric, points, streams, first_ms, last_ms) of the metrics there are."""
    return points.groupBy("metric").agg(F.count("*").alias("points"), F.count_distinct("stream").alias("streams"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


def label_values(points: DataFrame) -> DataFrame:
    """(metric, label, value, points) of all labels with a value."""
    return points.select("metric", F.explode("attributes").alias("label", "value")).filter("value <> ''").groupBy("metric", "label", "value").agg(F.count("*").alias("points"))


def counter_rate(points: DataFrame, step_ms: int, *by: str) -> DataFrame:
    """(bucket_ms, rate) of cumulative counters, summed over streams.

    An increment belongs to the bucket of its later point; a decrease is a restart at zero, points at equal times
    are skipped. A stream's rate in a bucket is its increments over the time they cover, from the first earlier
    point to the last.
    """
    kept = points.groupBy("stream", "ts_ms", *by).agg(F.min_by("value", "event_id").alias("value"))
    order = Window.partitionBy("stream").orderBy("ts_ms")
    pairs = kept.withColumn("before", F.lag("value").over(order)).withColumn("since", F.lag("ts_ms").over(order)).filter("since is not null")
    gain = F.when(F.col("value") >= F.col("before"), F.col("value") - F.col("before")).otherwise(F.col("value"))
    each = pairs.groupBy("stream", *by, _bucket(step_ms)).agg((1000 * F.sum(gain) / (F.max("ts_ms") - F.min("since"))).alias("rate"))
    return each.groupBy(*by, "bucket_ms").agg(F.sum("rate").alias("rate"))


def delta_rate(points: DataFrame, step_ms: int, *by: str) -> DataFrame:
    """(bucket_ms, rate) of counters that report increments: their sum over the step."""
    return points.groupBy(*by, _bucket(step_ms)).agg((1000 * F.sum("value") / step_ms).alias("rate"))


def histogram_quantile(points: DataFrame, q: float, step_ms: int, cumulative: bool = True) -> DataFrame:
    """(bucket_ms, value) of points (stream, ts_ms, bounds, counts); counts have one entry more than bounds.

    Cumulative streams are differenced first: the first point gives nothing, a fall in the total or other bounds
    are a restart. Counts of a step are summed by bucket. Within a bucket the value is interpolated; the first
    bucket gives its upper bound, the last the highest bound. Steps without an observation give no row.
    """
    if cumulative:
        order = Window.partitionBy("stream").orderBy("ts_ms")
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
        pairs = points.withColumn("total", total).withColumn("old", F.lag(F.struct("counts", "bounds", "total")).over(order)).filter("old is not null")
        restart = (F.col("old.total") > F.col("total")) | (F.col("old.bounds") != F.col("bounds"))
        points = pairs.withColumn("counts", F.when(restart, F.col("counts")).otherwise(F.zip_with("counts", "old.counts", lambda a, b: a - b)))
    cells = points.select(_bucket(step_ms), "bounds", F.posexplode("counts").alias("i", "n")).groupBy("bucket_ms", "bounds", "i").agg(F.sum("n").alias("n"))
    by_bucket = Window.partitionBy("bucket_ms", "bounds").orderBy("i")
    running = cells.withColumn("to", F.sum("n").over(by_bucket)).withColumn("all", F.sum("n").over(Window.partitionBy("bucket_ms", "bounds"))).filter("`all` > 0")
    rank = F.lit(q) * F.col("all")
    hit = running.filter((F.col("to") >= rank) & (F.col("n") > 0)).groupBy("bucket_ms", "bounds").agg(F.min(F.struct("i", "n", "to", "all")).alias("x")).select("bucket_ms", "bounds", "x.*")
    high = F.try_element_at("bounds", F.col("i") + 1)
    low = F.try_element_at("bounds", F.when(F.col("i") > 0, F.col("i")))
    value = F.when(F.col("i") >= F.size("bounds"), F.element_at("bounds", -1)).when(F.col("i") == 0, high).otherwise(low + (high - low) * (rank - (F.col("to") - F.col("n"))) / F.col("n"))
    return hit.select("bucket_ms", value.alias("value"))
