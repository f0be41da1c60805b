"""Rollups and latest-version tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.model import DAY_MS, HOUR_MS


def latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The newest row of each key. Filter on other columns afterwards: an older row may pass where the newest fails."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("row"))
    return newest.select(*keys, "row.*")


def hourly(events: DataFrame) -> DataFrame:
    """Pageviews, events and uniques by hour, page and type; uniques do not add up over rows."""
    return events.groupBy(F.expr(f"(ts_ms div {HOUR_MS}) * {HOUR_MS}").alias("bucket_ms"), "pathname", "event_type").agg(
        F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("visit_id").alias("visits")
    )


def daily(events: DataFrame) -> DataFrame:
    """The same by day, with browser and country."""
    return events.groupBy(F.expr(f"(ts_ms div {DAY_MS}) * {DAY_MS}").alias("bucket_ms"), "event_type", "browser", "country").agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"))


def unique_sketches(events: DataFrame, width_ms: int) -> DataFrame:
    """(bucket_ms, sketch): HyperLogLog sketches of sessions, which do add up (F.hll_union_agg)."""
    return events.groupBy(F.expr(f"(ts_ms div {width_ms}) * {width_ms}").alias("bucket_ms")).agg(F.hll_sketch_agg("session_id", 14).alias("sketch"))


def session_summaries(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Sessions recomputed from the events that are left, joined to earlier summaries where those begin earlier."""
    old = prior.select("session_id", *[F.col(c).alias(f"old_{c}") for c in ("first_ms", "last_ms", "events", "entry_page")])
    earlier = F.col("old_first_ms") < F.col("first_ms")
    both = current.join(old, "session_id", "full_outer")
    return both.select(
        "session_id", F.least("old_first_ms", "first_ms").alias("first_ms"), F.greatest("old_last_ms", "last_ms").alias("last_ms"),
        F.when(F.col("events").isNull(), F.col("old_events")).when(earlier, F.greatest("old_events", "events")).otherwise(F.col("events")).alias("events"),
        F.when(F.col("events").isNull() | earlier, F.col("old_entry_page")).otherwise(F.col("entry_page")).alias("entry_page"),
    )


def expired(df: DataFrame, now_ms: int, days: int) -> DataFrame:
    """What a retention of so many days keeps."""
    return df.filter(F.col("ts_ms") >= now_ms - days * DAY_MS)
